"""Readers and writers of the engine's text records, and integrity checks of media files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import ratio


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files, lines counted from 1, also in files that are read in several splits.

    A row's number in its split is its distance from the split's first row, as a task numbers its rows one by one; before it stand
    the rows of the file's earlier splits. Only the splits' counts are summed up; no line is moved.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("raw"))
    splits = lines.groupBy("file", "__from").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "__from", (before + 1 - F.col("__first")).alias("__to_line"))
    return lines.join(offsets, ["file", "__from"]).select("file", (F.col("__id") + F.col("__to_line")).alias("line"), "raw")


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row for each non-blank line: file, line number, raw text, the record, and why it is refused (A1).

    A line that is not a JSON object is an error row; so is a file without any line of text. The raw text stays for checks of unknown keys.
    """
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = numbered_lines(spark, path).where(F.col("raw").rlike(r"\S"))
    kind, ok = F.substring(F.trim("raw"), 1, 1), F.try_parse_json("raw").isNotNull()
    rows = lines.select("file", "line", "raw", F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("record"), F.when(~ok, "bad_json").when(kind != "{", "not_an_object").alias("error"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    empty = files.join(lines.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).cast("long").alias("line"), F.lit("").alias("raw"), F.lit(None).cast(schema).alias("record"), F.lit("empty_file").alias("error"))
    return rows.unionByName(empty)


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a known schema; blank lines are skipped (A2)."""
    return spark.read.schema(schema).json(path)


def keyed_findings(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings whose key occurs once, and the keys that occur more often or hold no array, which are refused (A3)."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("findings").isNull()).alias("without"))
    bad = counted.where((F.col("n") > 1) | (F.col("without") > 0))
    return rows.join(bad, keys, "left_anti"), bad


def truth_of(manifest: DataFrame, truth: DataFrame, root: str) -> DataFrame:
    """Frames of what manifest rows name: a file, or a folder of part files, by path under the root (A4).

    ``truth`` has file; a row whose path has no frames stays with null columns and the error ``absent``.
    """
    relative = F.regexp_replace(F.col("file"), f"^.*?{re.escape(root.rstrip('/'))}/", "")
    paths = F.array_distinct(F.array(relative, F.regexp_replace(relative, "/[^/]*$", "")))
    joined = manifest.join(truth.withColumn("truthPath", F.explode(paths)), "truthPath", "left")
    return joined.withColumn("error", F.when(F.col("file").isNull(), "absent"))


def media_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and sha256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


def against_locks(found: DataFrame, locks: DataFrame) -> DataFrame:
    """Locked artifacts and whether they are there as locked; locks are a short list."""
    seen = found.select("name", F.col("bytes").alias("f_bytes"), F.col("digest").alias("f_digest"))
    joined = locks.join(seen, "name", "left")
    status = F.when(F.col("f_digest").isNull(), "ABSENT").when((F.col("bytes") == F.col("f_bytes")) & (F.col("digest") == F.col("f_digest")), "OK").otherwise("DIFFERS")
    return joined.select("name", status.alias("status"))


class _Markers:
    """Walks the segments of one JPEG file, of which the bytes come in pieces; keeps the few bytes of a segment's head alone."""

    def __init__(self) -> None:
        self.began, self.done, self.size = False, False, (None, None)
        self.skip, self.held = 0, b""

    def feed(self, piece: bytes) -> None:
        """The next bytes; those before the next segment are passed over."""
        if self.skip >= len(piece):
            self.skip -= len(piece)
            return
        held, at = self.held + piece[self.skip :], 0
        self.skip = 0
        while not self.done:
            step = self._step(held[at : at + 9])
            if step is None:
                break
            self.began = True
            at += step
        self.skip, self.held = max(0, at - len(held)), held[at:]

    def _step(self, head: bytes) -> int | None:
        """How far the next segment begins; None where more bytes are needed or the walk ends."""
        if not self.began:
            if len(head) < 2:
                return None
            self.done = head[:2] != b"\xff\xd8"
            return None if self.done else 2
        if len(head) < 9:
            return None
        marker = head[1]
        if head[0] != 0xFF:
            self.done = True
            return None
        if marker == 0xFF:
            return 1
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[5:9])
            self.done, self.size = True, (width, height)
            return None
        return 2 if marker in (0x01, *range(0xD0, 0xD8)) else 2 + struct.unpack(">H", head[2:4])[0]


def jpeg_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height from the markers of a JPEG file; none if it is not one."""
    walk = _Markers()
    walk.feed(content)
    return walk.size


def jpeg_sizes(files: DataFrame, piece_bytes: int = 1 << 16) -> DataFrame:
    """Path, width and height of images (A8), null where the content is null or no JPEG.

    The first bytes of each file go to Python; the files whose size these do not show send the rest too, in pieces that follow each other
    in the task, so that a batch holds pieces and not whole files. Segments before the size may be of any number and length.
    """

    @F.pandas_udf("struct<width:int,height:int,open:boolean>")
    def first(heads: pd.Series) -> pd.DataFrame:
        walks = []
        for head in heads:
            walks.append(_Markers())
            walks[-1].feed(bytes(head or b""))
        sizes = {c: pd.array([w.size[i] for w in walks], dtype="Int32") for i, c in enumerate(("width", "height"))}
        return pd.DataFrame({**sizes, "open": [not w.done for w in walks]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Markers()
        for batch in batches:
            out = []
            for path, width, height, i, last, piece in zip(*(batch[c] for c in ("path", "width", "height", "i", "last", "piece"))):
                if piece is not None:
                    walk = _Markers() if i == 0 else walk
                    walk.feed(bytes(piece)) if not walk.done else None
                    width, height = walk.size
                if i == last:
                    out.append((path, width, height))
            yield pd.DataFrame({"path": pd.Series([o[0] for o in out], dtype=object), **{c: pd.array([None if pd.isna(o[k]) else int(o[k]) for o in out], dtype="Int32") for k, c in ((1, "width"), (2, "height"))}})

    n = F.octet_length("content")
    told = files.select("path", "content", first(F.substring(F.col("content"), 1, piece_bytes)).alias("h"))
    last = F.when(F.col("h.open") & (n > piece_bytes), F.ceil(n / piece_bytes).cast("int") - 1).otherwise(0)
    parts = told.select("path", "content", "h", last.alias("last")).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
    piece = F.when(F.col("last") > 0, F.substring(F.col("content"), F.col("i") * piece_bytes + 1, F.lit(piece_bytes)))
    return parts.select("path", "h.width", "h.height", "i", "last", piece.alias("piece")).mapInPandas(run, "path string, width int, height int")


def sorted_json(row_columns: list[str]) -> Column:
    """A record as compact JSON with its keys in order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(row_columns))))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One compact record a line, keys in order."""
    rows.select(sorted_json(rows.columns).alias("value")).write.mode("overwrite").text(path)


#: A line of the report; keys as they are written.
REPORT_LINE = "schemaVersion string, suite string, gridSize int, overallAverageIntentionallyOmitted boolean, split string, lane string, category string, frames long, " + ", ".join(
    f"{n} struct<numerator:long,denominator:long,value:double>" for n in ("recall", "localizationCoverage", "excessiveMask", "falsePositives")
)


def report_lines(sums: DataFrame, suite: str, grid: int) -> DataFrame:
    """The report of a suite, one JSON line for each split, lane and category, with the suite's name and grid on each; no overall average."""
    col = F.col
    parts = {
        "recall": ratio(col("recalled"), col("targets")), "localizationCoverage": ratio(col("covered_cells"), col("truth_cells")),
        "excessiveMask": ratio(col("excess_cells"), col("frames") * grid * grid), "falsePositives": ratio(col("false_positives"), col("findings")),
    }
    head = {"schemaVersion": F.lit("1.0.0"), "suite": F.lit(suite), "gridSize": F.lit(grid), "overallAverageIntentionallyOmitted": F.lit(True), "split": col("split"), "lane": col("lane"), "category": col("category"), "frames": col("frames")}
    fields = sorted({**head, **parts}.items())
    return sums.select("split", "lane", "category", F.to_json(F.struct(*(c.alias(n) for n, c in fields)), {"ignoreNullFields": "false"}).alias("line"))


def fraction(numerator: Column, denominator: Column) -> Column:
    """n/d as text, 0/0 where nothing is counted."""
    return F.when(denominator == 0, F.lit("0/0")).otherwise(F.concat_ws("/", numerator.cast("long"), denominator.cast("long")))


def markdown_rows(report: DataFrame, keys: list[str], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """Lines of a Markdown table."""
    cells = [F.col(k).cast("string") for k in keys] + [fraction(F.col(n), F.col(d)) for n, d in parts.values()]
    return report.select(*keys, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def event_line(event: Column, category: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A log line without payload: coordinates as basis points."""
    points = lambda name, c: F.concat(F.lit(f" {name}="), F.floor(c * 10000 + 0.5).cast("string"))
    return F.concat(F.lit("event="), event, F.lit(" category="), category, points("l", left), points("t", top), points("r", right), points("b", bottom))


def read_event_line(line: Column) -> Column:
    """The pairs of a log line as a map."""
    return F.str_to_map(line, F.lit(" "), F.lit("="))
