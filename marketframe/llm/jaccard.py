"""Jaccard join of documents on word shingles by grouped prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks, data, table, text_bytes
from .linking import among
from .stars import counter, groups, inside, rarity, verified
from .words import mix, shingle_sets

WORDS = 5
#: Two documents link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 75, 100

#: Shingles that prefixes must share. Different sets that link have as many in common.
SHARED = 3


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x for part in chunks([batch], "text") for x in shingle_sets(*data(part.column("text")), WORDS)]


def _signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    one, two = mix(values + np.uint64(0x9E37)), mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return tuple(np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)]).view(np.int64).tolist())


def prefix_length(n: int) -> int:
    """Of two linked sets, each has ``SHARED`` of the common values among the first so many of
    its own, in any one order: more than a quarter of n values can't be missing in the other."""
    return min(n - -(-n * NUM // DEN) + SHARED, n)


def _prefix(values: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest values of a set, in one order for all sets."""
    count = often[counter(values)]
    return values[np.lexsort((values, count))[: prefix_length(len(values))]]


def signed_sets(rows: DataFrame, often: np.ndarray) -> DataFrame:
    """``doc_id, n, s1, s2, p1, p2, keys``: size and signature of each document's set,
    signature of its prefix and the prefix; zeros and nothing for empty sets."""

    def run(batches):
        for part in chunks(batches, "text"):
            sets = _sets(part)
            prefixes = [_prefix(x, often) for x in sets]
            out = [(len(x), *_signature(x), *_signature(p)) if len(x) else (0,) * 5 for x, p in zip(sets, prefixes)]
            columns = [part.column(0), pa.array([x[0] for x in out], pa.int32())]
            columns += [pa.array([x[k] for x in out], pa.int64()) for k in range(1, 5)]
            ends = pa.array(np.cumsum([0, *map(len, prefixes)]).astype(np.int32))
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            columns.append(pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n", "s1", "s2", "p1", "p2", "keys"]
    return rows.mapInArrow(run, "doc_id bigint, n int, s1 bigint, s2 bigint, p1 bigint, p2 bigint, keys array<bigint>")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * DEN < max(len(x), len(y)) * NUM:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def fits(x: Column, y: Column) -> Column:
    return F.least(x["size"], y["size"]) * DEN >= F.greatest(x["size"], y["size"]) * NUM


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every row.

    1. Documents with one set are a class, classes with one prefix and size a group.
    2. Groups whose prefixes share a rare value are compared with a pivot of it, members
       with their group's first (``stars``); verified links give connected groups.
    3. Prefixes are joined once more: pairs of groups that share enough of them and are
       not connected yet are expanded to members and verified as well. So no link
       is missed, while thousands of near copies cost a few comparisons a member.

    A prefix holds the shingles that fewest documents have; that order is a matter of
    cost, so bounded counters do. A null or empty text, or one without words, has an
    empty set and is its own component. Equal texts are linked through their class,
    repeated rows included. Keys are taken for unique: rows with one key are one node.
    Rows with a null key get their class's component, null if the class has no other
    key. Other columns are not read. Nothing is cut: whole texts, however long, and all
    pairs of different components. An empty table gives an empty result.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("id"), text_bytes(text).alias("text"))
    often = rarity(rows.select("text"), lambda batch: np.concatenate([np.empty(0, np.uint64), *_sets(batch)]))
    sets = materialise(signed_sets(rows, often))
    by = ["n", "s1", "s2"]
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*by).agg(
        F.min("doc_id").alias("id"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    classes = materialise(classes)
    grouped = classes.groupBy("n", "p1", "p2").agg(F.min("id").alias("node"), F.count("*").alias("members"))
    grouped = materialise(grouped)
    keys = among(sets.select("doc_id", "n", "keys"), grouped.select(F.col("node").alias("id")), "doc_id")
    # Rows with one key are one node: the first of their sets.
    nodes = materialise(keys.select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "keys").where("size > 0").dropDuplicates(["id"]))
    several = grouped.where("members > 1").select("n", "p1", "p2", "node")
    members = materialise(classes.join(several.hint("merge"), ["n", "p1", "p2"]).select("node", "id"))
    found = groups(
        nodes, fits, lambda pairs: verified(pairs, rows, _sets, similar), SHARED, members,
        within=lambda near: inside(near, rows, _sets, NUM, DEN),
    )
    discard(nodes, members, grouped)

    linked = classes.select("id", *by).join(found.hint("merge"), "id", "left").select(*by, F.coalesce("component", "id").alias("component"))
    out = sets.select("doc_id", *by).join(linked.hint("merge"), by, "left")
    return out.select(
        F.col("doc_id").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text in SQL.
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

SQL = f"""WITH RECURSIVE split AS (SELECT doc_id, {SQL_WORDS} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {WORDS - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 2}, 2))) AS i FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {DEN} * common >= {NUM} * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
