"""Merkle manifest of a dataset by slot pivot: conditional aggregates spread each parent's children into columns.

A leaf is the digest of a row's fields. Leaves of a group stand in the order of the key; every ``FANOUT`` consecutive
nodes become one, until a group has one node, its subroot. The groups' subroots, ordered by group (null first, then by
UTF-8 bytes), become the root in the same way. Joining a parent's slot columns gives its digest; leaving the own slot
out gives the siblings, the nodes to its left and right apart, so that a leaf can be folded up to the root again.

Null fields count as ``-``, so a null differs from an empty text. Rows with the same key stand in the order of their
digests; equal rows are leaves of their own. A null key comes first in its group. An empty table gives no rows. Columns
that are not named take no part. A text of any length is hashed whole. A group of any size is dealt by range, and no task
sees more than ``FANOUT`` nodes of one parent at a time; what the driver learns is the largest group's size and the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, scratch
from veilframe.llm.ordinals import placed

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-``, or the bytes' number, a colon and the value's text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """A group as text that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text, in lower case (A to Z alone) where 5 divides the crc32 of the id's digits."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder."""
    at = scratch(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row a parent: its children in slot columns, its digest, and the number of parents in its group.

    ``nodes``: g, place, group_rows and ``node``, a struct whose field ``digest`` is the node's.
    """
    slot = F.col("place") % fanout
    spread = nodes.groupBy("g", F.expr(f"place div {fanout}").alias("up"), F.expr(f"(group_rows + {fanout - 1}) div {fanout}").alias("ups")).agg(
        *(F.max(F.when(slot == k, F.col("node"))).alias(name) for k, name in enumerate(_slots(fanout)))
    )
    joined = F.concat_ws("", *(F.col(name)["digest"] for name in _slots(fanout)))
    return spread.select("g", F.col("up").alias("place"), F.col("ups").alias("group_rows"), *_slots(fanout), F.struct(F.sha2(joined, 256).alias("digest")).alias("node"))


def _children(parents: DataFrame, fanout: int) -> DataFrame:
    """The children of rows (g, place, slots, path, ...) as (g, place, node, path): their siblings first, then their parent's path."""
    names = _slots(fanout)
    each = [
        F.struct(
            F.lit(k).alias("k"), F.col(name).alias("node"),
            F.struct(F.concat_ws("", *(F.col(x)["digest"] for x in names[:k])).alias("left"), F.concat_ws("", *(F.col(x)["digest"] for x in names[k + 1 :])).alias("right")).alias("own"),
        )
        for k, name in enumerate(names)
    ]
    rest = [c for c in parents.columns if c not in ("g", "place", "group_rows", "node", "path", *names)]
    one = parents.select("g", "place", "path", *rest, F.explode(F.filter(F.array(*each), lambda x: x["node"].isNotNull())).alias("__c"))
    return one.select("g", (F.col("place") * fanout + F.col("__c.k")).alias("place"), F.col("__c.node").alias("node"), F.concat(F.array("__c.own"), "path").alias("path"), *rest)


@dataclass
class Tree:
    """The levels of one or many trees: ``levels[0]`` holds the leaves, each further level the parents with their slots."""

    levels: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """(g, digest): the one node that remains of each group."""
        return reduce(DataFrame.unionByName, [x.where("group_rows = 1").select("g", F.col("node.digest").alias("digest")) for x in self.levels])

    def leaves_with_paths(self, above: DataFrame) -> DataFrame:
        """(g, node, path, and what else ``above`` has) of every leaf; ``above``: (g, path, ...) of the groups' last nodes."""
        rest = [c for c in above.columns if c not in ("g", "path")]
        found, down = [], None
        for level in reversed(self.levels):
            last = level.where("group_rows = 1").join(above, "g")
            here = last if down is None else last.unionByName(level.where("group_rows > 1").join(down.select("g", "place", "path", *rest), ["g", "place"]))
            if level is self.levels[0]:
                found.append(last.select("g", "node", "path", *rest))
                if down is not None:
                    found.append(down.select("g", "node", "path", *rest))
            else:
                down = _children(here, self.fanout)
        return reduce(DataFrame.unionByName, found)


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """All levels above ``leaves`` (g, place, group_rows, node), each written once; each is at most 1/16 and one node a group larger than that below."""
    most = leaves.agg(F.max("group_rows")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        most = -(-most // fanout)
        levels.append(_kept(_parents(levels[-1].where("group_rows > 1"), fanout), "merkle"))
    return Tree(levels, fanout)


@dataclass
class Manifest:
    """The trees of the groups and the tree over their subroots."""

    inner: Tree
    outer: Tree
    root: str | None

    def subroots(self) -> DataFrame:
        """(source, subroot); ``source`` is the group as text."""
        return self.inner.tops().select(F.expr("CASE WHEN g <> '0' THEN substring(g, 2) END").alias("source"), F.col("digest").alias("subroot"))

    def proofs(self) -> DataFrame:
        """Every leaf's node struct, its subroot and its path to the root."""
        top = self.outer.tops().select("g", F.array().cast(PATH).alias("path"))
        above = self.outer.leaves_with_paths(top).select(F.col("node.group").alias("g"), "path", F.col("node.digest").alias("subroot"))
        return self.inner.leaves_with_paths(above).select("node", "subroot", "path")


def manifest(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table; ``carry`` names further expressions that a leaf's node keeps beside key and digest."""
    named = {name: F.col(name) for name in columns}
    digests = rows.select(
        group_key(F.col(group)).alias("g"), F.col(key).alias("key"), leaf(list(named.values())).alias("digest"), *(value.alias(name) for name, value in (carry or {}).items())
    )
    inner = placed(digests, "g", ["key", "digest"])
    inner = grow(inner.select("g", "place", "group_rows", F.struct("digest", "key", *(carry or {})).alias("node")), fanout)
    tops = placed(inner.tops().select(F.lit("").alias("all"), F.col("g").alias("group"), "digest"), "all", ["group"])
    outer = grow(tops.select(F.col("all").alias("g"), "place", "group_rows", F.struct("digest", "group").alias("node")), fanout)
    root = outer.tops().select("digest").first()
    return Manifest(inner, outer, root and root[0])


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf_digest, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path joined, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, proof and whether the leaf of its text as found now still gives the root."""
    found = {name: F.col(name) for name in COLUMNS} | {"text": tampered_text(F.col("doc_id"), F.col("text"))}
    built = manifest(documents(spark, sf_dir), carry={"now": leaf(list(found.values()))})
    fold = folded(F.col("node.now"), F.col("path"))
    rows = built.proofs().select(
        F.col("node.key").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", F.lit(built.root).cast("string").alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT *, 1 AS one FROM (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM documents)),
u AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now_text FROM t),
f AS (SELECT r, doc_id, coalesce('1' || source, '0') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(now_text) || ':' || now_text, '-') AS now_tail FROM u),
d AS (SELECT r, doc_id, g, sha256(head || tail) AS h, sha256(head || now_tail) AS now_h FROM f),
lv AS (
  SELECT g, 0 AS lvl, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, r, doc_id, now_h FROM d
),
nodes AS (
  SELECT g, lvl, i, n, h FROM lv
  UNION ALL
  SELECT g, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 16, n
),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 16, n
),
sib AS (
  SELECT a.g, a.lvl, a.i, coalesce(string_agg(CASE WHEN b.i < a.i THEN b.h END, '' ORDER BY b.i), '') AS l, coalesce(string_agg(CASE WHEN b.i > a.i THEN b.h END, '' ORDER BY b.i), '') AS rt
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.i
),
topsib AS (
  SELECT a.lvl, a.i, coalesce(string_agg(CASE WHEN b.i < a.i THEN b.h END, '' ORDER BY b.i), '') AS l, coalesce(string_agg(CASE WHEN b.i > a.i THEN b.h END, '' ORDER BY b.i), '') AS rt
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.lvl, a.i
),
inner_walk AS (
  SELECT r, g, 0 AS lvl, i, now_h AS h, '' AS proof FROM lv
  UNION ALL
  SELECT w.r, w.g, w.lvl + 1, w.i // 16, sha256(s.l || w.h || s.rt), w.proof || s.l || s.rt FROM inner_walk w JOIN sib s ON w.g = s.g AND w.lvl = s.lvl AND w.i = s.i
),
at_sub AS (SELECT w.r, s.i, w.h, w.proof FROM inner_walk w JOIN nodes n ON w.g = n.g AND w.lvl = n.lvl AND w.i = n.i JOIN subs s ON s.g = w.g WHERE n.n = 1),
outer_walk AS (
  SELECT r, 0 AS lvl, i, h, proof FROM at_sub
  UNION ALL
  SELECT w.r, w.lvl + 1, w.i // 16, sha256(s.l || w.h || s.rt), w.proof || s.l || s.rt FROM outer_walk w JOIN topsib s ON w.lvl = s.lvl AND w.i = s.i
),
done AS (SELECT w.r, w.h, w.proof, t.h AS root FROM outer_walk w JOIN tops t ON w.lvl = t.lvl AND w.i = t.i WHERE t.n = 1)
SELECT lv.doc_id, lv.h AS leaf, subs.subroot, done.root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = done.root AS verified
FROM lv JOIN subs USING (g) JOIN done USING (r)
"""
