"""Queries of sources, sinks and corpus builders, over rows that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe import derive
from veilframe.functions.geometry import Rect
from veilframe.plans import evaluation
from veilframe.plans.views import sql
from veilframe.shared import scratch
from veilframe.sources import blocks as b
from veilframe.sources import corpora as c
from veilframe.sources import records as r


def _line(when: str, k: str, raw: str) -> str:
    return f"IF({when}, named_struct('k', {k}, 'raw', {raw}), NULL)"


def _lines_of(spark, sf, *lines: str) -> DataFrame:
    """(frame, k, raw): the lines that each box gives, with n, the boxes of its frame, at hand; boxes are numbered and counted once."""
    t = derive.truth_box(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("frame")))
    return t.selectExpr("frame", f"inline(array_compact(array({', '.join(lines)})))")


def _block_lines(spark, sf):
    """An order's lines written as one block: name, count, rows of ten numbers; a file has the orders of 256 keys in a row.

    Some names occur twice, and some blocks are empty, with a row of zeros in place of boxes.
    """
    name, count = _line("obj = 1", "0L", "concat('f', frame - IF(frame % 97 = 0, 1, 0), '.jpg')"), _line("obj = 1", "1L", "IF(frame % 89 = 0, '0', CAST(n AS STRING))")
    row = _line("frame % 89 <> 0 OR obj = 1", "obj + 1L", "IF(frame % 89 = 0, '0 0 0 0 0 0 0 0 0 0', concat_ws(' ', pk, sk, ln, obj, 1, 0, 0, 0, 2, IF(obj = 3, NULL, '1')))")
    return _lines_of(spark, sf, name, count, row).selectExpr("concat('file', frame div 256) AS file", "frame * 1000 + k AS at", "raw")


def a5_blocks(spark, sf):
    return b.block_text(_block_lines(spark, sf)).select("filename", "block", "declared", "box", "x", "y", "width", "pose")


def _broken_lines(spark, sf):
    """Files of one order each, written as blocks, with one thing wrong in many of them, by the order's key."""
    first, twice = "obj = 1", "obj = 1 AND frame % 16 = 11"
    name = _line(first, "0L", "CASE frame % 16 WHEN 1 THEN '../up.jpg' WHEN 2 THEN '/top.jpg' ELSE concat('d//f', frame, '.jpg') END")
    count = _line(f"{first} AND frame % 16 <> 3", "1L", "CASE frame % 16 WHEN 4 THEN 'many' WHEN 5 THEN '-1' WHEN 6 THEN CAST(n + 1 AS STRING) WHEN 7 THEN '0' WHEN 8 THEN '0' ELSE CAST(n AS STRING) END")
    row = _line("frame % 16 NOT IN (3, 7, 8)", "obj + 1L", "CASE WHEN frame % 16 = 9 AND obj = 2 THEN '1 2 3' WHEN frame % 16 = 10 AND obj = 2 THEN '1 2 3 4 5 6 7 8 9 x' ELSE concat_ws(' ', pk, sk, ln, obj, 1, 0, 0, 0, 2, 1) END")
    zeros = _line(f"{first} AND frame % 16 = 8", "2L", "'9 9 9 9 9 9 9 9 9 9'")
    again = [_line(twice, f"n + {k}", raw) for k, raw in ((2, "''"), (3, "concat('d/f', frame, '.jpg')"), (4, "'0'"), (5, "'0 0 0 0 0 0 0 0 0 0'"))]
    return _lines_of(spark, sf, name, count, row, zeros, *again).selectExpr("CAST(frame AS STRING) AS file", "k AS at", "raw")


def a5_block_errors(spark, sf):
    """Every error of block files: those of the blocks above, and those of files with one thing wrong each."""
    found = [b.block_errors(b.block_lines(lines, full=False)) for lines in (_block_lines(spark, sf), _broken_lines(spark, sf))]
    return found[0].unionByName(found[1])


def a3_findings(spark, sf):
    rows = derive.truth_box(spark, sf).select("frame", "ln", F.when(F.col("pk") % 9 != 0, F.array("category")).alias("findings"))
    return r.keyed_findings(rows, ["frame", "ln"])[1]


def _files(rows, name, value="raw"):
    """Writes rows of (g, at, raw) as text, a folder of one file for each g with its rows in order; the folder's path."""
    path = scratch(rows.sparkSession, name)
    rows.repartition("g").sortWithinPartitions("g", "at").select("g", F.col(value).alias("value")).write.partitionBy("g").text(path)
    return path


#: A group of a file is 256 keys in a row, so files grow in number with the table.
_G = "o_orderkey div 256"


def _group(path):
    return F.regexp_extract(path, "/g=([0-9]+)/", 1).cast("long")


def _raw_lines(spark, sf):
    return derive.table(spark, sf, "orders").selectExpr(
        f"{_G} AS g", "o_orderkey AS at", "o_custkey",
        "CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN '{' WHEN o_orderkey % 11 = 0 THEN '[1]' ELSE concat('{\"id\":', o_orderkey, ',\"name\":\"c', o_custkey, '\"}') END AS raw",
    )


def a1_lines(spark, sf):
    """Lines of files that Spark has written, some blank, some broken."""
    rows = r.strict_jsonl(spark, _files(_raw_lines(spark, sf), "a1"), "id long, name string")
    return rows.select(_group("file").alias("g"), "line", "error", F.when(F.col("error").isNull(), F.col("record.id")).alias("id"))


def a2_records(spark, sf):
    path = _files(_raw_lines(spark, sf).where("raw LIKE '{_%' OR raw = ' '"), "a2")
    return r.lenient_jsonl(spark, path, "id long, name string").select("id", "name")


def a4_truth(spark, sf):
    """Truth folders that a manifest names, one of which is absent."""
    t = derive.truth_box(spark, sf).selectExpr("frame div 256 AS g", "frame * 100 + obj AS at", "concat('{\"frame\":', frame, ',\"obj\":', obj, '}') AS raw")
    path = _files(t.where("g % 7 <> 3"), "a4")
    truth = spark.read.schema("frame long, obj long").json(path).select("*", F.col("_metadata.file_path").alias("file")).drop("g")
    manifest = derive.truth_box(spark, sf).selectExpr("frame div 256 AS fixture").distinct().selectExpr("fixture", "concat('g=', fixture) AS truthPath")
    return r.truth_of(manifest, truth, path.split("/")[-1]).select("fixture", "frame", "obj", "error")


def _coco_files(spark, sf):
    """A folder of COCO files, one for 256 frames, each written as one row."""
    t = derive.truth_box(spark, sf).select(F.expr("frame div 256").alias("g"), "frame", "obj", "left", "top", "right", "bottom")
    box = F.array(*(F.col(c) * 64 for c in ("left", "top")), (F.col("right") - F.col("left")) * 64, (F.col("bottom") - F.col("top")) * 64)
    note = F.struct((F.col("frame") * 100 + F.col("obj")).alias("id"), F.col("frame").alias("image_id"), (F.col("obj") % 3).alias("category_id"), box.alias("bbox"))
    # A frame's image comes with its first object.
    image = F.when((F.col("obj") == 1) & (F.col("frame") % 10 != 0), F.struct(F.col("frame").alias("id"), F.concat("frame", F.lit(".jpg")).alias("file_name"), F.lit(64).alias("width"), F.lit(64).alias("height")))
    files = t.repartition("g").groupBy("g").agg(F.to_json(F.collect_list(note)).alias("a"), F.to_json(F.collect_list(image)).alias("i"))
    categories = F.lit('[{"id":0,"name":"a"},{"id":1,"name":"b"}]')
    path = scratch(spark, "a6")
    # Tasks move their files themselves, as the driver would one after the other.
    files.select(F.concat(F.lit('{"annotations":'), "a", F.lit(',"categories":'), categories, F.lit(',"images":'), "i", F.lit("}")).alias("value")).write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    return path


def a6_coco(spark, sf):
    """COCO files, each with its images, categories and annotations, read as three tables and joined."""
    images, categories, notes = c.coco_tables(spark, _coco_files(spark, sf))
    return c.coco_star(images, categories.distinct(), notes).select("id", "file_name", "category", "error", F.round(F.col("polygon")[2][0], 9).alias("x1"))


def a7_digests(spark, sf):
    """Sizes and digests of written files."""
    files = r.media_digests(spark, _files(_raw_lines(spark, sf), "a7"))
    return files.select(_group("path").alias("g"), "bytes", "digest")


def a8_jpeg(spark, sf):
    """Headers of JPEG files with a segment before the size; some are cut short."""
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    p, n = derive.table(spark, sf, "part"), F.col("p_size").cast("long")
    head = F.concat(F.unhex(F.lit("FFD8FFE000046162FFC0001108")), two(n * 7 + 1), two(n * 11 + 3), F.unhex(F.lit("00000000")))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 9 == 0, F.substring(head, 1, 9)).otherwise(head).alias("content"))
    return r.jpeg_sizes(files)


def a8_long_headers(spark, sf):
    """JPEG files with one to five segments before the size, one file in twenty with up to 300 KB of them; some end inside a segment."""
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    p, n = derive.table(spark, sf, "part"), F.col("p_size").cast("long")
    length = F.when(F.col("p_partkey") % 20 == 0, 20000 + n * 800).otherwise(n + 2)
    segments = F.aggregate(F.sequence(F.lit(1), (F.col("p_partkey") % 7 % 5).cast("int") + 1), F.unhex(F.lit("FFD8")), lambda a, i: F.concat(a, F.unhex(F.lit("FFE1")), two(length), F.unhex(F.repeat(F.lit("FF"), (length - 2).cast("int")))))
    whole = F.concat(segments, F.unhex(F.lit("FFC2001108")), two(n * 7 + 1), two(n * 11 + 3), F.unhex(F.lit("0301")))
    content = F.when(F.col("p_partkey") % 180 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 6)).otherwise(whole)
    return r.jpeg_sizes(p.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))


def h4_plan(spark, sf):
    """The plan of the thirteen fixtures of one split, in order of path."""
    items = derive.table(spark, sf, "supplier").selectExpr("concat('s', s_nationkey, '/', s_suppkey, '.png') AS path", "sha2(s_name, 256) AS digest", "CASE WHEN s_suppkey <= 13 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split")
    plan = c.staging_plan(items, items.select("path", "digest"), "DEVELOPMENT", 13)
    return plan.where("problem IS NULL").withColumn("place", F.row_number().over(Window.orderBy("path"))).select("place", "path")


def a9_records(spark, sf):
    rows = derive.table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS a_size")
    return rows.select("id", r.sorted_json(rows.columns).alias("line"))


def a11_markdown(spark, sf):
    rows = derive.truth_box(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("ln") > 9).alias("none"), F.count_if(F.col("ln") > 3).alias("high"))
    return r.markdown_rows(rows, ["category"], {"high": ("high", "n"), "none": ("none", "none")})


def a12_locks(spark, sf):
    docs = derive.table(spark, sf, "documents")
    found = docs.where("doc_id % 10 <> 0").selectExpr("CAST(doc_id AS STRING) AS name", "n_chars AS bytes", "sha2(text, 256) AS digest")
    locks = docs.selectExpr("CAST(doc_id AS STRING) AS name", "n_chars AS bytes", "sha2(concat(text, IF(doc_id % 7 = 0, 'x', '')), 256) AS digest")
    return r.against_locks(found, locks)


def a13_event_lines(spark, sf):
    t = derive.truth_box(spark, sf).withColumn("line", r.event_line(F.lit("mask"), F.col("category"), *Rect.of()))
    back = r.read_event_line(F.col("line"))
    return t.select("frame", "obj", "line", back["l"].cast("int").alias("l"), back["category"].alias("category"))


def e14_coco(spark, sf):
    images = derive.table(spark, sf, "part").where("p_partkey % 11 <> 0").selectExpr("p_partkey AS id", "concat(p_partkey, '.jpg') AS file_name", "640 AS width", "480 AS height")
    categories = derive.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name")
    notes = derive.truth_box(spark, sf).selectExpr("frame * 100 + obj AS id", "pk AS image_id", "sk % 27 AS category_id", "array(left * 640, top * 480, (right - left) * 640, (bottom - top) * 480) AS bbox")
    return c.coco_star(images, categories, notes).select("id", "file_name", "category", F.col("polygon")[2][0].alias("x1"), "error")


def k1_manifest(spark, sf):
    items = derive.table(spark, sf, "supplier").selectExpr("s_name AS name", "IF(s_suppkey % 2 = 0, 'DEVELOPMENT', 'HOLDOUT') AS split")
    return c.public_manifest(items, "pub", "seed-1").select("fixtureId", "name", F.col("leakageKeys.sourceGroupId").alias("source_group"), "split")


def k2_staging(spark, sf):
    docs = derive.table(spark, sf, "documents")
    items = docs.selectExpr("concat('d', doc_id % 3, '/', doc_id div 3, '.jpg') AS path", "sha2(text, 256) AS digest", "lang AS split")
    found = items.selectExpr("path", "IF(path LIKE '%7.jpg', 'x', digest) AS digest")
    return c.staging_plan(items, found, "en", 13)


def k3_retention(spark, sf):
    o = derive.table(spark, sf, "orders")
    ledger = o.selectExpr("o_orderkey AS asset", "CAST(o_orderdate AS DATE) AS deadline")
    return c.retention_audit(ledger, o.selectExpr("o_orderkey AS asset", "o_orderstatus = 'F' AS complete"), "1996-01-01").select("asset")


def a10_report(spark, sf):
    """The report written as lines and read back; there is no overall row."""
    lines = r.report_lines(evaluation.suite(spark, sf), "suite-1", evaluation.GRID)
    back = lines.select(F.from_json("line", r.REPORT_LINE).alias("x")).select("x.*")
    part = lambda c, n: (F.col(c).numerator.alias(f"{n}_n"), F.col(c).denominator.alias(f"{n}_d"))
    return back.select(
        F.col("schemaVersion").alias("schema_version"), "suite", F.col("gridSize").alias("grid_size"), "split", "lane", "category", "frames", *part("recall", "recall"), F.round("recall.value", 9).alias("recall"),
        *part("localizationCoverage", "coverage"), *part("excessiveMask", "excess"), *part("falsePositives", "false"), F.col("overallAverageIntentionallyOmitted").alias("omitted"),
    )


_RAW = """l AS (SELECT o_orderkey // 256 AS g, o_orderkey AS pos, CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN '{' WHEN o_orderkey % 11 = 0 THEN '[1]' ELSE '{"id":' || o_orderkey || ',"name":"c' || o_custkey || '"}' END AS raw FROM orders)"""

ORACLE = {
    "a1_lines": f"""WITH {_RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS line FROM l)
        SELECT g, line, CASE WHEN raw = '{{' THEN 'bad_json' WHEN raw = '[1]' THEN 'not_an_object' END AS error, CASE WHEN raw LIKE '{{_%' THEN pos END AS id FROM n WHERE raw <> ' ' UNION ALL SELECT g, 0, 'empty_file', NULL FROM l GROUP BY g HAVING bool_and(raw = ' ')""",
    "a2_records": "SELECT o_orderkey AS id, 'c' || o_custkey AS name FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0",
    "a4_truth": sql("SELECT frame // 256 AS fixture, frame, obj, NULL AS error FROM truth_box WHERE frame // 256 % 7 <> 3 UNION ALL SELECT DISTINCT frame // 256, NULL::BIGINT, NULL::BIGINT, 'absent' FROM truth_box WHERE frame // 256 % 7 = 3", "truth_box"),
    "a6_coco": sql("""SELECT frame * 100 + obj AS id, CASE WHEN frame % 10 <> 0 THEN frame || '.jpg' END AS file_name, CASE obj % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS category, CASE WHEN frame % 10 = 0 THEN 'image' WHEN obj % 3 = 2 THEN 'category' END AS error,
        CASE WHEN frame % 10 <> 0 AND obj % 3 <> 2 THEN round(least(1, "right"), 9) END AS x1 FROM truth_box""", "truth_box"),
    "a7_digests": f"WITH {_RAW} SELECT g, sum(length(raw) + 1)::BIGINT AS bytes, sha256(string_agg(raw || chr(10), '' ORDER BY pos)) AS digest FROM l GROUP BY g",
    "a8_long_headers": "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 180 <> 0 THEN (p_size * 11 + 3)::INT END AS width, CASE WHEN p_partkey % 180 <> 0 THEN (p_size * 7 + 1)::INT END AS height FROM part",
    "a8_jpeg": "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 9 <> 0 THEN (p_size * 11 + 3)::INT END AS width, CASE WHEN p_partkey % 9 <> 0 THEN (p_size * 7 + 1)::INT END AS height FROM part",
    "h4_plan": "SELECT row_number() OVER (ORDER BY path)::INT AS place, path FROM (SELECT 's' || s_nationkey || '/' || s_suppkey || '.png' AS path FROM supplier WHERE s_suppkey <= 13) WHERE (SELECT count(*) FROM supplier WHERE s_suppkey <= 13) = 13",
    "a5_blocks": sql("SELECT 'f' || (frame - (frame % 97 = 0)::INT) || '.jpg' AS filename, frame * 1000 AS block, count(*) OVER (PARTITION BY frame)::INT AS declared, obj::INT AS box, pk::INT AS x, sk::INT AS y, ln::INT AS width, CASE WHEN obj = 3 THEN NULL ELSE 1 END AS pose FROM truth_box WHERE frame % 89 <> 0", "truth_box"),
    "a5_block_errors": sql("""WITH t AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, frame % 16 AS m FROM truth_box),
        b AS (SELECT 'file' || frame // 256 AS file, 'f' || (frame - (frame % 97 = 0)::INT) || '.jpg' AS filename, frame * 1000 AS "at", frame FROM truth_box WHERE obj = 1),
        o AS (SELECT frame, obj, n, m, frame::VARCHAR AS file, CASE m WHEN 1 THEN '../up.jpg' WHEN 2 THEN '/top.jpg' ELSE 'd/f' || frame || '.jpg' END AS filename FROM t),
        f AS (SELECT * FROM o WHERE obj = 1)
        SELECT 'file' || frame // 256 AS file, 'f' || (frame - (frame % 97 = 0)::INT) || '.jpg' AS filename, frame * 1000 + obj + 1 AS "at", 'fields' AS code FROM truth_box WHERE obj = 3 AND frame % 89 <> 0
        UNION ALL SELECT file, filename, "at", 'duplicate' FROM b QUALIFY row_number() OVER (PARTITION BY file, filename ORDER BY "at") > 1
        UNION ALL SELECT file, filename, 0, 'name' FROM f WHERE m IN (1, 2)
        UNION ALL SELECT file, filename, 0, 'no_count' FROM f WHERE m = 3
        UNION ALL SELECT file, filename, 1, CASE m WHEN 4 THEN 'count' ELSE 'negative' END FROM f WHERE m IN (4, 5)
        UNION ALL SELECT file, filename, n + 1, 'truncated' FROM f WHERE m = 6
        UNION ALL SELECT file, filename, 1, 'no_placeholder' FROM f WHERE m = 7
        UNION ALL SELECT file, filename, 2, 'placeholder' FROM f WHERE m = 8
        UNION ALL SELECT file, filename, obj + 1, CASE m WHEN 9 THEN 'fields' ELSE 'integer' END FROM o WHERE m IN (9, 10) AND obj = 2
        UNION ALL SELECT file, filename, n + 3, 'duplicate' FROM f WHERE m = 11""", "truth_box"),
    "a3_findings": sql("SELECT frame, ln, count(*) AS n, count(*) FILTER (pk % 9 = 0) AS without FROM truth_box GROUP BY frame, ln HAVING count(*) > 1 OR count(*) FILTER (pk % 9 = 0) > 0", "truth_box"),
    "a9_records": """SELECT p_partkey AS id, '{"a_size":' || p_size || ',"id":' || p_partkey || ',"name":"' || p_name || '"}' AS line FROM part""",
    "a11_markdown": sql("SELECT category, '| ' || category || ' | ' || count(*) FILTER (ln > 3) || '/' || count(*) || ' | 0/0 |' AS line FROM truth_box GROUP BY category", "truth_box"),
    "a12_locks": "SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 10 = 0 THEN 'ABSENT' WHEN doc_id % 7 = 0 THEN 'DIFFERS' ELSE 'OK' END AS status FROM documents",
    "a13_event_lines": sql("""SELECT frame, obj, 'event=mask category=' || category || ' l=' || floor("left" * 10000 + 0.5::DOUBLE)::BIGINT || ' t=' || floor(top * 10000 + 0.5::DOUBLE)::BIGINT || ' r=' || floor("right" * 10000 + 0.5::DOUBLE)::BIGINT || ' b=' || floor(bottom * 10000 + 0.5::DOUBLE)::BIGINT AS line,
        floor("left" * 10000 + 0.5::DOUBLE)::INT AS l, category FROM truth_box""", "truth_box"),
    "e14_coco": sql("""SELECT frame * 100 + obj AS id, i.p_partkey || '.jpg' AS file_name, n_name AS category, CASE WHEN i.p_partkey IS NOT NULL AND n_name IS NOT NULL THEN least(1, "right") END AS x1, CASE WHEN i.p_partkey IS NULL THEN 'image' WHEN n_name IS NULL THEN 'category' END AS error
        FROM truth_box LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) i ON i.p_partkey = pk LEFT JOIN nation ON n_nationkey = sk % 27""", "truth_box"),
    "k1_manifest": "SELECT 'pub-' || lpad((row_number() OVER (ORDER BY sha256('seed-1' || s_name), s_name))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY sha256('seed-1' || s_name), s_name))::VARCHAR))::INT, '0') AS fixtureId, s_name AS name, sha256(s_name)[1:20] AS source_group, CASE WHEN s_suppkey % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split FROM supplier",
    "k2_staging": """WITH i AS (SELECT 'd' || doc_id % 3 || '/' || doc_id // 3 || '.jpg' AS path, doc_id // 3 AS name, (doc_id // 3) % 10 = 7 AS differs FROM documents WHERE lang = 'en')
        SELECT path, CASE WHEN differs THEN 'digest' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'name' WHEN count(*) OVER () <> 13 THEN 'number' END AS problem FROM i""",
    "k3_retention": "SELECT o_orderkey AS asset FROM orders WHERE o_orderdate::DATE < DATE '1996-01-01' AND o_orderstatus <> 'F'",
    "a10_report": evaluation.REPORT_SQL,
}
QUERIES = {f.__name__: f for f in (a1_lines, a2_records, a4_truth, a6_coco, a7_digests, a8_jpeg, a8_long_headers, h4_plan, a3_findings, a5_blocks, a5_block_errors, a9_records, a10_report, a11_markdown, a12_locks, a13_event_lines, e14_coco, k1_manifest, k2_staging, k3_retention)}
