"""Queries of joins, windows, choices and set audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import derive
from veilframe.functions.geometry import Rect
from veilframe.operators import relations as r
from veilframe.plans.views import sql

LANES = ["FACE", "TEXT", "BARCODE"]


def _truth(spark, sf):
    return derive.truth_box(spark, sf)


def _frames(spark, sf):
    return derive.session_frames(spark, sf)


def e1_keys(spark, sf):
    t = _truth(spark, sf)
    return r.matched_and_extra(t.select("frame", "obj"), derive.pred_box(t).selectExpr("frame", "pred + (frame % 7 = 0) :: int AS obj"), ["frame", "obj"])


def e2_as_of(spark, sf):
    f = _frames(spark, sf)
    return r.as_of(f, derive.snapshots(f), LANES).select("session", "frame", "lane", "basis", "source_ns", "failed")


def j18_freshness(spark, sf):
    f = _frames(spark, sf)
    return r.freshness(r.as_of(f, derive.snapshots(f), LANES), 3_600_000_000_000_000).select("session", "frame", "lane", "fresh")


def e4_nearest(spark, sf):
    f = _frames(spark, sf)
    decoded = f.where("event_id % 11 <> 0").selectExpr("session", "ts_ns + (event_id % 7 - 3) * 1000 AS at")
    return r.nearest_monotonic(f.selectExpr("session", "ts_ns AS at"), decoded, "session", 3000)


def _decisions(f):
    return f.where("event_id % 5 <> 0 AND frame >= 4").selectExpr("session", "ts_ns", "CASE WHEN event_type = 'error' THEN 'FULL_SHIELD' ELSE 'REGIONAL_SAFE' END AS status", "ts_ns + 100 AS expires_ns")


def e5_lookup(spark, sf):
    f = _frames(spark, sf)
    return r.decision_lookup(f.selectExpr("session", "ts_ns", "ts_ns + event_id % 200 AS now_ns"), _decisions(f), f.where("frame < 4 AND event_id % 2 = 0"), 90)


def _elements(spark, sf):
    # Texts are dealt by document before they are taken apart, so that their words lie by document and are not moved one by one.
    docs = derive.table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.posexplode(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("element", "text"))
    return docs.selectExpr("doc_id", "CAST(element AS BIGINT) AS element", "text", "(element % 16) / 16D AS left", "floor(element / 16) / 64D AS top")


def g6_reading_order(spark, sf):
    return r.reading_order(_elements(spark, sf), "doc_id", 16384).groupBy("doc_id").agg(F.count("*").alias("elements"), F.max("end").alias("chars"), F.sum("start").alias("starts"), F.count_if("within").alias("within"))


def e6_spans(spark, sf):
    e = r.reading_order(_elements(spark, sf), "doc_id")
    spans = derive.table(spark, sf, "documents").selectExpr("doc_id", "explode(sequence(0L, n_chars + 100, 97L)) AS start").selectExpr("doc_id", "start", "start + 5 AS end")
    return r.span_elements(e.select("doc_id", "element", "start", "end"), spans, "doc_id").groupBy("doc_id").agg(F.count("element").alias("hits"), F.count_if(F.col("element").isNull()).alias("misses"), F.sum("element").alias("elements"))


def e11_candidates(spark, sf):
    t = _truth(spark, sf)
    return r.track_candidates(t, derive.pred_box(t), "frame").select("frame", "obj", "pred", F.round("score", 6).alias("score"))


def e12_self_overlaps(spark, sf):
    return r.self_overlaps(_truth(spark, sf), "frame", "obj")


def e13_pick(spark, sf):
    t = _truth(spark, sf)
    taps = t.where("obj = 1").selectExpr("frame", "obj AS tap", "left + 1/64D AS x", "top + 1/64D AS y")
    return r.pick(taps, t.selectExpr("frame", "obj AS track", "left", "top", "right", "bottom", "ln < 5 AS fresh", "pk * 1000 AS age_ns"), "frame", 100000)


def e15_members(spark, sf):
    files = derive.table(spark, sf, "part").selectExpr("concat(p_brand, '/', p_type) AS path")
    wanted = derive.table(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN concat('x/', p_name) ELSE concat(p_brand, '/', p_type) END AS wanted").distinct()
    return r.resolve_members(wanted, files.distinct())


def b22_artifacts(spark, sf):
    docs = derive.table(spark, sf, "documents")
    found = docs.selectExpr("concat('a', doc_id % 900) AS name", "n_chars AS bytes", "sha2(text, 256) AS digest")
    required = docs.where("doc_id % 7 = 0").selectExpr("concat('a', doc_id % 900) AS name", "n_chars + (doc_id % 21 = 0) :: int AS bytes", "sha2(text, 256) AS digest")
    return r.artifact_audit(found, required, docs.where("doc_id % 50 = 3").selectExpr("concat('a', doc_id) AS name"))


def e18_drift(spark, sf):
    f = _frames(spark, sf)
    return r.positional_drift(f.selectExpr("session", "ts_ns div 1000 + event_id % 7 * 500 AS at"), f.selectExpr("session", "ts_ns div 1000 AS at"), "session")


def g5_order(spark, sf):
    return r.out_of_order(_frames(spark, sf), "session", "event_id", "ts_ns").select("session", "event_id")


def g8_changes(spark, sf):
    return r.changes(_frames(spark, sf), "session", "frame", "event_type").select("session", "frame", "event_type")


def g9_jumps(spark, sf):
    return r.jumps(_frames(spark, sf), "session", "frame", "value", 24).select("session", "frame", F.round("step", 6).alias("step"))


def g10_retention(spark, sf):
    return r.retention(_frames(spark, sf), "session", "frame", 8, 16).select("session", "frame", "fate")


def g11_trigger(spark, sf):
    return r.nth_trigger(_frames(spark, sf), "event_type", ["ts_ns", "event_id"], 3).select("event_type", "event_id", "fired")


def g12_suffix(spark, sf):
    f = _frames(spark, sf)
    seen = f.selectExpr("session", "frame AS at", "sha2(event_type, 256) AS digest")
    first = f.where("frame >= 5").selectExpr("session", "frame - 5 AS at", "CASE WHEN session % 3 = 0 AND frame = 6 THEN 'x' ELSE sha2(event_type, 256) END AS digest")
    return r.suffix_match(seen, first, "session")


def h1_choice(spark, sf):
    rows = derive.table(spark, sf, "part").selectExpr("concat(p_name, p_partkey) AS name", "array_compact(array(IF(p_size < 10, 'small', NULL), IF(p_size % 3 = 0, 'third', NULL), IF(p_size % 5 = 0, 'fifth', NULL), 'all')) AS slices")
    return r.stratified_choice(rows, ["small", "third", "fifth", "all"], 10, "name", "seed-1")


def h3_first(spark, sf):
    return r.first_in_key(_truth(spark, sf), "frame", ["top", "left", "obj"], 3).select("frame", "obj")


def h2_order(spark, sf):
    t = _truth(spark, sf)
    return t.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("left", "top", "right", "bottom", "obj"))).alias("a")).select("frame", F.transform("a", lambda x: x["obj"]).cast("string").alias("objs"))


def i1_leakage(spark, sf):
    """The six leakage keys of a manifest, two of them arrays."""
    rows = derive.table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN 'DEVELOPMENT' ELSE 'HOLDOUT' END AS split", "o_orderkey AS source", "array(o_custkey, o_custkey + 1) AS actors", "array(o_orderpriority, o_orderstatus) AS payloads",
        "array(o_custkey % 7) AS seeds", "IF(o_orderkey % 3 = 0, NULL, o_orderkey div 5) AS room", "CAST(round(o_totalprice * 100) AS BIGINT) AS digest",
    )
    return r.leaked_values(rows, "split", ["source", "actors", "payloads", "seeds", "room", "digest"])


def i2_union(spark, sf):
    a = derive.table(spark, sf, "customer").selectExpr("c_name AS item", "'C' AS corpus")
    return a.unionByName(derive.table(spark, sf, "supplier").selectExpr("s_name AS item", "'S' AS corpus")).groupBy("corpus").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


def i3_difference(spark, sf):
    t = _truth(spark, sf)
    return t.select("frame", "obj").exceptAll(derive.pred_box(t).select("frame", F.col("pred").alias("obj")))


def i6_merge(spark, sf):
    """Findings that agree in category, confidence and action."""
    found = _truth(spark, sf).selectExpr("frame", "category", "IF(is_blurred, 'LOW', 'HIGH') AS confidence", "IF(ln > 3, 'BLUR', 'OPAQUE') AS action", *Rect._fields)
    return r.merge_boxes(found, "frame", ["category", "confidence", "action"])


def i7_zones(spark, sf):
    t = _truth(spark, sf)
    return t.select("frame", *Rect._fields).unionByName(derive.pred_box(t).selectExpr("frame", "p_left AS left", "p_top AS top", "p_right AS right", "p_bottom AS bottom")).groupBy("frame").agg(F.count("*").alias("regions"))


def _units(f):
    return f.selectExpr("session", "event_type = 'purchase' AS is_key", "ts_ns AS arrival_ns", "CASE WHEN event_id % 9 <> 0 THEN ts_ns + 2000000000 + event_id % 1000 END AS released_ns")


def f11_release(spark, sf):
    return r.release_statistics(_units(_frames(spark, sf)), "session")


def f12_health(spark, sf):
    f = _frames(spark, sf)
    units = f.selectExpr("session", "CASE event_type WHEN 'signup' THEN 'CONFIG' WHEN 'purchase' THEN 'KEY' ELSE 'MEDIA' END AS kind", "ts_ns AS arrival_ns", "CASE WHEN event_id % 9 <> 0 THEN ts_ns + 2000 END AS released_ns", "event_id % 18 = 0 AS dropped")
    states = f.where("event_type IN ('error', 'click')").selectExpr("session", "ts_ns AS at", "IF(event_type = 'error', 'FAILED', 'PUBLISHING') AS state", "IF(event_type = 'error', 'CONNECT_FAILED', 'NONE') AS failure")
    return r.health(units, states, "session")


def i5_distinct(spark, sf):
    return _truth(spark, sf).select("frame", "category").distinct()


def f13_telemetry(spark, sf):
    return r.telemetry_snapshot(_frames(spark, sf), "session", 5).withColumn("newest", F.col("newest").cast("string"))


_ASOF = """f3 AS (SELECT session, frame, ts_ns, unnest(['FACE', 'TEXT', 'BARCODE']) AS lane FROM session_frames),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, lane, source_ns ORDER BY event_id) AS k FROM snapshots) WHERE k = 1),
    ao AS (SELECT f3.session, f3.frame, f3.ts_ns, f3.lane, one.source_ns, one.failed, one.valid_until_ns FROM f3 ASOF LEFT JOIN one ON f3.session = one.session AND f3.lane = one.lane AND f3.ts_ns >= one.source_ns),
    mx AS (SELECT session, lane, max(source_ns) AS newest FROM one GROUP BY ALL)"""
_WORDS = r"""w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS text, generate_subscripts(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) - 1 AS element FROM documents),
    o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM w)"""

ORACLE = {
    "e1_keys": sql("""WITH a AS (SELECT DISTINCT frame, obj FROM truth_box), b AS (SELECT DISTINCT frame, pred + (frame % 7 = 0)::INT AS obj FROM pred_box)
        SELECT frame, obj, CASE WHEN a.frame IS NULL THEN 'EXTRA' WHEN b.frame IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS status FROM a FULL JOIN b USING (frame, obj)""", "truth_box", "pred_box"),
    "e2_as_of": sql(f"WITH {_ASOF} SELECT session, frame, lane, CASE WHEN source_ns IS NOT NULL THEN 'FOUND' WHEN newest > ts_ns THEN 'FUTURE' ELSE 'MISSING' END AS basis, source_ns, failed FROM ao LEFT JOIN mx USING (session, lane)", "snapshots"),
    "j18_freshness": sql(f"WITH {_ASOF} SELECT session, frame, lane, coalesce(NOT failed AND ts_ns <= valid_until_ns AND ts_ns - source_ns <= 3600000000000000, false) AS fresh FROM ao", "snapshots"),
    "e4_nearest": sql("SELECT session, ts_ns AS \"at\", CASE WHEN event_id % 11 <> 0 THEN ts_ns + (event_id % 7 - 3) * 1000 END AS taken FROM session_frames", "session_frames"),
    "e5_lookup": sql("""WITH f AS (SELECT session, ts_ns, frame, event_id, event_type, ts_ns + event_id % 200 AS now_ns FROM session_frames),
        d AS (SELECT session, ts_ns, CASE WHEN event_type = 'error' THEN 'FULL_SHIELD' ELSE 'REGIONAL_SAFE' END AS st FROM f WHERE event_id % 5 <> 0 AND frame >= 4), n AS (SELECT session, max(ts_ns) AS newest FROM d GROUP BY session),
        l AS (SELECT f.session, f.ts_ns, st, CASE WHEN st IS NULL AND frame < 4 AND event_id % 2 = 0 THEN 'EVICTED' WHEN st IS NULL AND newest > f.ts_ns THEN 'FUTURE' WHEN st IS NULL THEN 'MISSING' WHEN event_id % 200 > 100 THEN 'EXPIRED' WHEN event_id % 200 > 90 THEN 'STALE' ELSE 'OK' END AS lookup
          FROM f LEFT JOIN d USING (session, ts_ns) LEFT JOIN n USING (session)) SELECT session, ts_ns, lookup, CASE WHEN lookup = 'OK' THEN st ELSE 'FULL_SHIELD' END AS status FROM l""", "session_frames"),
    "g6_reading_order": f"WITH {_WORDS} SELECT doc_id, count(*) AS elements, max(s + length(text)) AS chars, sum(s)::BIGINT AS starts, count(*) FILTER (s + length(text) <= 16384) AS within FROM o GROUP BY doc_id",
    "e6_spans": f"""WITH {_WORDS}, sp AS (SELECT doc_id, unnest(range(0, n_chars + 101, 97)) AS a FROM documents),
        j AS (SELECT sp.doc_id, a, element FROM sp LEFT JOIN o ON o.doc_id = sp.doc_id AND s < a + 5 AND s + length(text) > a)
        SELECT doc_id, count(element) AS hits, count(*) FILTER (element IS NULL) AS misses, sum(element)::BIGINT AS elements FROM j GROUP BY doc_id""",
    "e11_candidates": sql("""WITH p AS (SELECT *, greatest(0, least("right", p_right) - greatest("left", p_left)) * greatest(0, least(bottom, p_bottom) - greatest(top, p_top)) AS i, sqrt((("left" + "right") / 2 - (p_left + p_right) / 2) ** 2 + ((top + bottom) / 2 - (p_top + p_bottom) / 2) ** 2) AS d,
          greatest(("right" - "left") / (p_right - p_left), (p_right - p_left) / ("right" - "left"), (bottom - top) / (p_bottom - p_top), (p_bottom - p_top) / (bottom - top)) AS s FROM truth_box JOIN pred_box USING (frame)),
        q AS (SELECT *, i / (("right" - "left") * (bottom - top) + (p_right - p_left) * (p_bottom - p_top) - i) AS u FROM p) SELECT frame, obj, pred, round(u + 1 - least(1, d / 0.3::DOUBLE), 6) AS score FROM q WHERE u >= 0.1::DOUBLE OR (s <= 2 AND d <= 0.3::DOUBLE)""", "truth_box", "pred_box"),
    "e12_self_overlaps": sql("""WITH p AS (SELECT a.frame, a.obj, b.obj AS other, greatest(0, least(a."right", b."right") - greatest(a."left", b."left")) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS i,
        (a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top) AS t FROM truth_box a JOIN truth_box b ON a.frame = b.frame AND a.obj < b.obj) SELECT frame, obj, other FROM p WHERE i / (t - i) >= 0.3::DOUBLE""", "truth_box"),
    "e13_pick": sql("""WITH t AS (SELECT frame, obj AS tap, "left" + 1/64e0 AS x, top + 1/64e0 AS y FROM truth_box WHERE obj = 1),
        h AS (SELECT frame, tap, count(*) AS n, min(b.obj) AS track, bool_and(ln < 5 AND pk * 1000 <= 100000) AS ok FROM t JOIN truth_box b USING (frame) WHERE x BETWEEN b."left" AND b."right" AND y BETWEEN b.top AND b.bottom GROUP BY ALL)
        SELECT frame, tap, CASE WHEN n IS NULL THEN 'NO_FACE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN ok THEN 'SELECTED' ELSE 'STALE' END AS verdict, CASE WHEN n = 1 AND ok THEN track END AS track FROM t LEFT JOIN h USING (frame, tap)""", "truth_box"),
    "e15_members": """WITH f AS (SELECT DISTINCT p_brand || '/' || p_type AS path, p_type AS name FROM part), w AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN 'x/' || p_name ELSE p_brand || '/' || p_type END AS wanted FROM part),
        n AS (SELECT name, count(*) AS n, min(path) AS one FROM f GROUP BY name),
        j AS (SELECT wanted, coalesce(f.path, CASE WHEN n = 1 THEN one END) AS path, n FROM w LEFT JOIN f ON f.path = wanted LEFT JOIN n ON n.name = string_split(wanted, '/')[-1])
        SELECT wanted, path, CASE WHEN path IS NOT NULL THEN 'OK' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'ABSENT' END AS status FROM j""",
    "b22_artifacts": """WITH f AS (SELECT 'a' || (doc_id % 900) AS name, n_chars AS bytes, sha256(text) AS digest FROM documents), q AS (SELECT 'a' || (doc_id % 900) AS name, n_chars + (doc_id % 21 = 0)::INT AS bytes, sha256(text) AS digest FROM documents WHERE doc_id % 7 = 0)
        SELECT name, 'MISSING' AS problem FROM q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.name = q.name AND f.bytes = q.bytes AND f.digest = q.digest)
        UNION ALL SELECT name, 'FORBIDDEN' FROM f WHERE name IN (SELECT 'a' || doc_id FROM documents WHERE doc_id % 50 = 3) UNION ALL SELECT name, 'DUPLICATE' FROM f GROUP BY name HAVING count(*) > 1""",
    "e18_drift": sql("""WITH s AS (SELECT session, a AS sample_at, row_number() OVER (PARTITION BY session ORDER BY a) AS ordinal FROM (SELECT session, ts_ns // 1000 + event_id % 7 * 500 AS a FROM session_frames)), t AS (SELECT session, ts_ns // 1000 AS truth_at, row_number() OVER (PARTITION BY session ORDER BY ts_ns) AS ordinal FROM session_frames)
        SELECT session, ordinal::INT AS ordinal, sample_at, truth_at FROM s JOIN t USING (session, ordinal) WHERE abs(sample_at - truth_at) > 2000""", "session_frames"),
    "g5_order": sql("SELECT session, event_id FROM (SELECT *, max(ts_ns) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM session_frames) WHERE ts_ns <= m", "session_frames"),
    "g8_changes": sql("SELECT session, frame, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY session ORDER BY frame) AS p FROM session_frames) WHERE event_type IS DISTINCT FROM p", "session_frames"),
    "g9_jumps": sql("SELECT session, frame, round(s, 6) AS step FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY session ORDER BY frame)) AS s FROM session_frames) WHERE s >= 24", "session_frames"),
    "g10_retention": sql("SELECT session, frame, CASE WHEN k <= 8 THEN 'RETAINED' WHEN k <= 24 THEN 'EVICTED' ELSE 'FORGOTTEN' END AS fate FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY frame DESC) AS k FROM session_frames)", "session_frames"),
    "g11_trigger": sql("SELECT event_type, event_id, row_number() OVER (ORDER BY ts_ns, event_id) AS fired FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_ns, event_id) AS k FROM session_frames) WHERE k = 4", "session_frames"),
    "g12_suffix": sql("""WITH n AS (SELECT session, count(*) AS n, count(*) FILTER (frame >= 5) AS m FROM session_frames GROUP BY session)
        SELECT session, n - m AS priming, (NOT (session % 3 = 0 AND n > 6)) AND n - m BETWEEN 1 AND 160 AS ok FROM n WHERE m > 0""", "session_frames"),
    "h1_choice": """WITH p AS (SELECT p_name || p_partkey AS name, sha256('seed-1' || p_name || p_partkey) AS lot, p_size FROM part),
        a AS (SELECT name, lot, 'small' AS slice FROM p WHERE p_size < 10 ORDER BY lot, name LIMIT 10), b AS (SELECT name, lot, 'third' AS slice FROM p WHERE p_size % 3 = 0 AND name NOT IN (SELECT name FROM a) ORDER BY lot, name LIMIT 10),
        c AS (SELECT name, lot, 'fifth' AS slice FROM p WHERE p_size % 5 = 0 AND name NOT IN (SELECT name FROM a UNION SELECT name FROM b) ORDER BY lot, name LIMIT 10),
        d AS (SELECT name, lot, 'all' AS slice FROM p WHERE name NOT IN (SELECT name FROM a UNION SELECT name FROM b UNION SELECT name FROM c) ORDER BY lot, name LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""",
    "h3_first": sql('SELECT frame, obj FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY top, "left", obj) AS k FROM truth_box) WHERE k <= 3', "truth_box"),
    "h2_order": sql("""SELECT frame, '[' || string_agg(obj::VARCHAR, ', ' ORDER BY "left", top, "right", bottom, obj) || ']' AS objs FROM truth_box GROUP BY frame""", "truth_box"),
    "i1_leakage": """WITH o AS (SELECT o_orderkey % 2 AS s, * FROM orders), l AS (SELECT s, 'source' AS key, o_orderkey::VARCHAR AS value FROM o UNION ALL SELECT s, 'actors', unnest([o_custkey, o_custkey + 1])::VARCHAR FROM o UNION ALL SELECT s, 'payloads', unnest([o_orderpriority, o_orderstatus]) FROM o
          UNION ALL SELECT s, 'seeds', (o_custkey % 7)::VARCHAR FROM o UNION ALL SELECT s, 'room', (o_orderkey // 5)::VARCHAR FROM o WHERE o_orderkey % 3 <> 0 UNION ALL SELECT s, 'digest', round(o_totalprice * 100)::BIGINT::VARCHAR FROM o)
        SELECT key, value, count(DISTINCT s) AS splits FROM l GROUP BY ALL HAVING count(DISTINCT s) > 1""",
    "i2_union": "SELECT corpus, count(*) AS n, min(item) AS first_item FROM (SELECT c_name AS item, 'C' AS corpus FROM customer UNION ALL SELECT s_name, 'S' FROM supplier) GROUP BY corpus",
    "i3_difference": sql("SELECT frame, obj FROM truth_box WHERE obj % 5 = 4", "truth_box"),
    "i7_zones": sql("SELECT frame, count(*) AS regions FROM (SELECT frame FROM truth_box UNION ALL SELECT frame FROM pred_box) GROUP BY frame", "truth_box", "pred_box"),
    "f11_release": sql("""SELECT session, count(*) AS offered, count(*) FILTER (event_type = 'purchase') AS key_units, count(*) FILTER (event_id % 9 <> 0) AS released, min(2000000000 + event_id % 1000) FILTER (event_id % 9 <> 0) AS least_delay,
        max(2000000000 + event_id % 1000) FILTER (event_id % 9 <> 0) AS largest_delay, (sum(2000000000 + event_id % 1000) FILTER (event_id % 9 <> 0))::BIGINT // count(*) FILTER (event_id % 9 <> 0) AS mean_delay FROM session_frames GROUP BY session""", "session_frames"),
    "f12_health": sql("""WITH u AS (SELECT *, CASE event_type WHEN 'signup' THEN 'CONFIG' WHEN 'purchase' THEN 'KEY' ELSE 'MEDIA' END AS kind, event_id % 9 <> 0 AS out FROM session_frames),
        t AS (SELECT session, count(*) FILTER (kind = 'CONFIG') AS offered_config, count(*) FILTER (kind = 'KEY') AS offered_key, count(*) FILTER (kind = 'MEDIA') AS offered_media, count(*) FILTER (kind = 'CONFIG' AND out) AS released_config, count(*) FILTER (kind = 'KEY' AND out) AS released_key,
          count(*) FILTER (kind = 'MEDIA' AND out) AS released_media, count(*) FILTER (event_id % 18 = 0) AS dropped, min(ts_ns + 2000) FILTER (out) AS first_release, max(ts_ns + 2000) FILTER (out) AS last_release FROM u GROUP BY session),
        s AS (SELECT session, arg_max(event_type, ts_ns) AS e FROM session_frames WHERE event_type IN ('error', 'click') GROUP BY session)
        SELECT session, CASE e WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PUBLISHING' END AS state, CASE e WHEN 'error' THEN 'CONNECT_FAILED' WHEN 'click' THEN 'NONE' END AS failure, t.* EXCLUDE (session) FROM t LEFT JOIN s USING (session)""", "session_frames"),
    "i5_distinct": sql("SELECT DISTINCT frame, category FROM truth_box", "truth_box"),
    "f13_telemetry": sql("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ns DESC, event_id DESC) AS k FROM session_frames)
        SELECT session, count(*) FILTER (event_type = 'purchase') AS decisions, max(value) FILTER (k = 1) AS last_value, max(event_type) FILTER (k = 1) AS last_type, '[' || string_agg(event_id::VARCHAR, ', ' ORDER BY event_id) FILTER (k <= 5) || ']' AS newest FROM k GROUP BY session""", "session_frames"),
}
QUERIES = {f.__name__: f for f in (e1_keys, e2_as_of, j18_freshness, e4_nearest, e5_lookup, g6_reading_order, e6_spans, e11_candidates, e12_self_overlaps, e13_pick, e15_members, b22_artifacts, e18_drift, g5_order, g8_changes, g9_jumps, g10_retention, g11_trigger, g12_suffix, h1_choice, h2_order, h3_first, i1_leakage, i2_union, i3_difference, i6_merge, i7_zones, f11_release, f12_health, f13_telemetry, i5_distinct)}
