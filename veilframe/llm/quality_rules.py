"""Rule bitmask ledger: each rule is evaluated once per document; policies and ablations read only bits.

Uses DataFrame functions alone. A null text counts as empty: no words, every measure 0, and it fails
``few_words``. Repeated rows are judged one by one; an empty table gives an empty ledger; further columns of
the input are ignored by :func:`ledger` and kept by :func:`rejects_go`.
A word has at most the text's length, so measures fit in a long; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, words_of

#: Name and failing condition of each rule over the measures, in bit order. New rules go to the end, so that old ledgers stay readable.
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 20 * m["n_symbols"] > m["n_words"]),
    ("shouting", lambda m: 5 * m["n_shouts"] > m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"])),
)
BASE = ("few_words", "repeated_words")
#: The rules that each policy version enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "shouting", "repeated_lines", "word_length"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in rules)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in one text."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def starts(rows: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.array_compact(F.transform(rows, lambda x, k: F.when((k > 0) & same(x, F.greatest(k - 1, F.lit(0))) | same(x, k + 1), x["at"]))))

        found = _let(ordered, starts)
        begun = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last"))
        return F.aggregate(found, begun, step, lambda acc: acc["n"])

    # Most texts repeat no window; only the others are sorted.
    one = lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(repeated(hashes))
    return _let(windows, one)


def judged(text: Column) -> Column:
    """The measures of one text and ``fail_bits``, bit i set where rule i fails, as one struct.

    Each part is bound to a lambda's variable, so however the optimizer moves the expression no part runs twice.
    """
    text = F.coalesce(text, F.lit(""))

    def measures(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"!!+")).cast("long").alias("n_shouts"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def with_bits(m: Column) -> Column:
        bits = reduce(Column.bitwiseOR, [F.when(fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (_, fails) in enumerate(RULES)])
        return F.struct(*(m[c].alias(c) for c in MEASURES), bits.alias("fail_bits"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(_let(words_of(text), lambda w: _let(lines, lambda x: measures(w, x))), with_bits)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: its measures and ``fail_bits``."""
    return docs.select("doc_id", judged(F.col("text")).alias("judged")).select("doc_id", "judged.*")


def passes(fail_bits: Column, version: str = CURRENT) -> Column:
    """Whether no rule of the policy failed."""
    return fail_bits.bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", passes(F.col("fail_bits"), version))


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, fail it alone (so would return without it), and the bits all its failures share."""
    enforced, order = mask(POLICIES[version]), [name for name, _ in RULES]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(enforced).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = patterns.select("bits", "n", F.explode(F.array([F.struct(F.lit(name).alias("rule"), F.lit(1 << order.index(name)).cast("bigint").alias("bit")) for name in POLICIES[version]])).alias("r"))
    failed = per_rule.where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return failed.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_and("bits").alias("shared_bits"),
    )


def rejects_go(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that pass a policy, with all their columns, each row judged on its own text."""
    return docs.where(passes(judged(F.col("text"))["fail_bits"], version))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, base verdict and the current policy's verdict."""
    rows = apply_policy(ledger(documents(spark, sf_dir)))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", "n_shouts", "n_lines")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM n, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(regexp_extract_all(t, '!!+'))::BIGINT AS n_shouts, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        | CASE WHEN 20 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN 5 * n_shouts > n_words THEN 8 ELSE 0 END
        | CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
        | CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 63) = 0 AS kept, fail_bits, n_shouts, n_lines FROM b
"""
