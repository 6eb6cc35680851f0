"""Merkle manifest of a table: a tree for each source, a tree over their roots, and proofs.

Checkpoint and recompute: of a tree only every second level is stored. Who needs the
levels between, for the next stored level or for proofs, regenerates them from the
stored nodes of each aligned subtree (at most 256 of them) and drops them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import table

#: Nodes of a run, and of two levels of runs.
FANOUT = 16
SPAN = FANOUT * FANOUT

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def tree_name(source: Column) -> Column:
    """A string that sorts as sources do, null first; never null itself."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with ``pos``, their place in column ``tree`` by ``order``, and ``n``, the
    tree's size.

    Rows are dealt by ranges of (tree, order), so a tree of any size is spread over
    tasks. A task's runs of a tree then add up to each run's first place: one row per
    task and tree.
    """
    ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(ordered.select("*", F.spark_partition_id().alias("part"), row.alias("row")))
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("row").alias("lowest"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("lowest")
    runs = runs.select("tree", "part", start.alias("start"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    placed = placed.join(runs, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("start"))
    return placed.select(*nodes.columns, "pos", "n")


def run_digests(nodes: Column) -> Column:
    """Digests of each 16 of an array of digests."""
    last = ((F.size(nodes) - 1) / FANOUT).cast("int")
    joined = lambda i: F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(joined(i), 256))


def subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """``tree, block, n, members``: the nodes of each aligned subtree in order."""
    block = F.expr(f"pos div {SPAN}").alias("block")
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *more)))
    return nodes.groupBy("tree", block).agg(F.first("n").alias("n"), members.alias("members"))


def two_up(nodes: DataFrame) -> DataFrame:
    """``tree, pos, n, digest`` two levels higher, or one where that ends the tree."""
    digests = F.transform("members", lambda m: m["digest"])
    grouped = subtrees(nodes).select("tree", "block", "n", run_digests(digests).alias("upper"))
    top = F.when(F.col("n") <= FANOUT, F.element_at("upper", 1)).otherwise(F.sha2(F.array_join("upper", ""), 256))
    return grouped.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).cast("bigint").alias("n"), top.alias("digest"))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels, leaves first; a tree ends where its ``n`` is 1."""
    levels = [leaves]
    while not levels[-1].where("n > 1").isEmpty():
        levels.append(materialise(two_up(levels[-1].where("n > 1"))))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of each tree's root."""
    ends = [nodes.where("n = 1").select("tree", "digest") for nodes in levels]
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def _step(nodes: Column, place: Column) -> Column:
    """The siblings before and behind a node of a run."""
    join = lambda a, n: F.array_join(F.slice(nodes, a, n), "")
    return F.struct(join(F.lit(1), place).alias("left"), join(place + 2, F.lit(FANOUT)).alias("right"))


def proved(levels: list[DataFrame], start: DataFrame, *more: str) -> DataFrame:
    """The lowest nodes with ``path``, the siblings of each level up to the root and on.

    ``start`` has each tree's path beyond its root, and columns to hand down. Stored
    levels are gone through from the top; a subtree's inner levels exist only while
    its rows are built. ``more`` names columns of the lowest level.
    """
    down = [c for c in start.columns if c not in ("tree", "path")]
    above = None
    for depth, nodes in reversed(list(enumerate(levels))):
        mine = more if depth == 0 else ()
        own = ["tree", "pos", "digest", *mine]
        out = nodes.where("n = 1").select(*own).join(start, "tree").select(*own, "path", *down)
        if above is not None:
            up = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("_up"), *down)
            met = subtrees(nodes.where("n > 1"), *mine).join(up, ["tree", "block"])
            met = met.withColumn("lower", F.transform("members", lambda m: m["digest"]))
            met = met.withColumn("upper", run_digests(F.col("lower")))

            def prove(m: Column, i: Column) -> Column:
                run, place = (i / FANOUT).cast("int"), i % FANOUT
                first = _step(F.slice("lower", run * FANOUT + 1, FANOUT), place)
                steps = F.when(F.col("n") <= FANOUT, F.array(first)).otherwise(F.array(first, _step(F.col("upper"), run)))
                return F.struct(m.alias("node"), F.concat(steps, "_up").alias("path"))

            each = met.select("tree", *down, F.explode(F.transform("members", prove)).alias("each"))
            out = out.union(each.select("tree", *[f"each.node.{c}" for c in own[1:]], "each.path", *down))
        above = out
    return above


def folded(path: Column, start: Column) -> Column:
    """The root that a digest and its proof lead to."""
    return F.aggregate(path, start, lambda own, s: digest(s["left"], own, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, from below and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class Manifest:
    """Stored levels of the sources' trees and of the tree over their roots."""

    sources: list[DataFrame]
    top: list[DataFrame]

    def roots(self) -> DataFrame:
        """``tree, digest``: root of each source (named as by ``tree_name``)."""
        return roots(self.sources)

    def root(self) -> DataFrame:
        """``digest``: one row, none for an empty table."""
        return roots(self.top).select("digest")

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, probe, subroot, root, path`` of every row."""
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        end = roots(self.top).select("tree", nothing.alias("path"), F.col("digest").alias("root"))
        over = proved(self.top, end, "name")
        start = over.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
        rows = proved(self.sources, start, "doc_id", "probe")
        return rows.select("doc_id", F.col("digest").alias("leaf"), "probe", "subroot", "root", "path")

    def discard(self) -> None:
        discard(*self.sources[1:], *self.top[1:])


def build(documents: DataFrame, source: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
          probe: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table.

    A leaf is the digest of ``fields``; null and empty values differ. A source's leaves
    ascend by ``key``, null keys first, and by their digests where keys are equal;
    repeated rows are leaves each. A null source is a source of its own and comes
    first. An empty table has no root. ``probe`` replaces columns: the leaf of such a
    row is kept beside the true one, to be tried against the true siblings. Other
    columns are not read. No field is too long, and a source of any size is spread
    over tasks by ranges of its keys.
    """
    probe = probe or {}
    changed = leaf(*[probe.get(c, F.col(c)) for c in fields])
    rows = documents.select(
        tree_name(F.col(source)).alias("tree"), F.col(key).cast("bigint").alias("doc_id"), leaf(*map(F.col, fields)).alias("digest"),
        (changed if probe else F.lit(None).cast("string")).alias("probe"), F.monotonically_increasing_id().alias("at"),
    )
    leaves = materialise(numbered(materialise(rows), ["doc_id", "digest", "at"]).drop("at"))
    levels = grown(leaves)
    names = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return Manifest(levels, grown(materialise(numbered(materialise(names), ["name"]))))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The query tampers with rows whose key's checksum this number divides.
TAMPERED = 5


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    lowered = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    rows = build(table(spark, sf_dir, "documents"), probe={"text": lowered}).proofs()
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("probe")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_leaf(text: str) -> str:
    fields = [text if c == "text" else c for c in FIELDS]
    one = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(one)})"


_SQL_LEVEL = f"""list_transform(range(0, (len(nodes) + {FANOUT - 1}) // {FANOUT}),
    lambda i : sha256(array_to_string(nodes[i * {FANOUT} + 1 : i * {FANOUT} + {FANOUT}], '')))"""
_SQL_SIDES = f"""array_to_string(nodes[place // {FANOUT} * {FANOUT} + 1 : place], '') AS l,
    array_to_string(nodes[place + 2 : place // {FANOUT} * {FANOUT} + {FANOUT}], '') AS r"""

SQL = f"""WITH RECURSIVE hits AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c : ascii(c)::BIGINT)),
    lambda a, b : list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y : xor(x >> 1, 3988292384 * (x & 1))))) % {TAMPERED} = 0 AS hit FROM documents),
leaves AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
    CASE WHEN hit THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_sql_leaf('text')} END AS probe,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_sql_leaf('text')}) - 1 AS pos FROM hits),
levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY source
  UNION ALL SELECT source, level + 1, {_SQL_LEVEL} FROM levels WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_SQL_LEVEL} FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, leaf, level, {_SQL_SIDES} FROM (
    SELECT d.doc_id, d.leaf, v.level, v.nodes, d.pos // ({FANOUT} ** v.level)::BIGINT AS place
    FROM leaves d JOIN levels v ON v.source IS NOT DISTINCT FROM d.source WHERE len(v.nodes) > 1)
  UNION ALL SELECT doc_id, leaf, level, {_SQL_SIDES} FROM (
    SELECT d.doc_id, d.leaf, v.level + 1000 AS level, v.nodes, s.pos // ({FANOUT} ** v.level)::BIGINT AS place
    FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN tops v WHERE len(v.nodes) > 1)),
paths AS (
  SELECT d.doc_id, d.leaf, d.probe, d.source, coalesce(list({{'l': l, 'r': r}} ORDER BY level) FILTER (level IS NOT NULL), []) AS path
  FROM leaves d LEFT JOIN steps p ON p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.leaf = d.leaf GROUP BY ALL),
fold AS (
  SELECT doc_id, leaf, source, path, 0 AS done, probe AS own FROM paths
  UNION ALL SELECT doc_id, leaf, source, path, done + 1, sha256(path[done + 1].l || own || path[done + 1].r) FROM fold WHERE done < len(path)),
ends AS (SELECT * FROM fold WHERE done = len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s : s.l || s.r), '')) AS proof_sha256,
  own AS folded_root, own = root AS verified
FROM ends JOIN subroots s ON s.source IS NOT DISTINCT FROM ends.source CROSS JOIN (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)"""
