"""Nearest neighbours by a forest of hash prefixes (LSH Forest, Bawa and others 2005).

Each tree orders all vectors by a string of hash bits. A query descends to its longest
matching prefixes and ascends in all trees at once, from long to short prefixes, until
the vectors below its prefixes are as many as asked for; these are compared exactly.
A tree's array is cut into blocks by the first bits of the strings, so a block is a
sorted array of bounded size in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import table

TREES, BITS, SEED = 24, 32, 11

#: A query's share: the vectors below its prefixes, summed over the trees, are at least
#: so many for each vector of the table. Vectors without any structure, like the test
#: table's, need this much for a recall above 0.9; real embeddings need less.
SHARE = 1.1

#: Fewer vectors than this are all compared.
ALL = 512

#: Vectors of a block, levels below a block's own prefix, queries that meet a block at once.
BLOCK, LEVELS, QUERIES = 8192, 5, 1 << 17

#: Vectors, those of the smallest hashes, whose medians centre the hash bits.
SAMPLE = 4096


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different vectors as ``id, vector`` (the smallest of their keys), and ``id, key``
    of all rows. Equal vectors are one class, however many they are."""
    different = materialise(rows.groupBy("vector").agg(F.min("key").alias("id")))
    members = materialise(rows.join(different, "vector").select("id", "key").distinct())
    return different, members


def planes(dim: int) -> np.ndarray:
    """Random directions, orthogonal inside a tree as far as the dimension allows."""
    rng = np.random.default_rng(SEED)
    trees = []
    for _ in range(TREES):
        parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-BITS // dim))]
        trees.append(np.hstack(parts)[:, :BITS])
    return np.hstack(trees)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component makes all vectors equally long, so that the largest inner
    product is the smallest angle (Neyshabur and Srebro 2015)."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]])


class Hashes:
    """The forest's hash function."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        self.planes = planes(sample.shape[1] + 1)
        self.centre = np.median(lifted(sample, longest) @ self.planes, axis=0)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """A number of ``BITS`` bits for each vector and tree. A query has length one and no lift."""
        if query:
            x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            x = lifted(x, self.longest)
        bits = (x @ self.planes > self.centre).reshape(len(x), TREES, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def hashed(vectors: DataFrame, hashes: Hashes, query: bool) -> DataFrame:
    """``id, vector`` with ``hashes``, one for each tree."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = hashes(_matrix(part.column("vector")), query)
                ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * TREES)
                codes = pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, codes], ["id", "vector", "hashes"])

    return vectors.select("id", "vector").mapInArrow(run, "id bigint, vector array<float>, hashes array<bigint>")


def _prefix(code: Column, level: int | Column) -> Column:
    return F.call_function("shiftright", code, (F.lit(BITS) - level).cast("int"))


def levels_of(queries: DataFrame, counts: DataFrame, wanted: int, deepest: int) -> DataFrame:
    """``id, tree, code, level``: how far up each query goes in each tree.

    The longest level whose counts, summed over the trees, reach ``wanted`` is taken in
    as many trees as are needed, in order; the others stay one level lower.
    """
    each = queries.select("id", F.posexplode("hashes").alias("tree", "code"))
    at = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    at = at.withColumn("prefix", _prefix(F.col("code"), F.col("level")))
    met = at.join(counts, ["tree", "level", "prefix"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("id", "level").agg(F.sum("n").alias("all"))
    top = sums.where((F.col("all") >= wanted) | (F.col("level") == 0)).groupBy("id").agg(F.max("level").alias("top"))
    near = met.join(top, "id").where((F.col("level") - F.col("top")).between(0, 1))
    both = near.groupBy("id", "tree", "code", "top").agg(
        F.sum(F.when(F.col("level") == F.col("top"), F.col("n")).otherwise(0)).alias("high"),
        F.sum(F.when(F.col("level") > F.col("top"), F.col("n")).otherwise(0)).alias("low"),
    )
    by_query = Window.partitionBy("id")
    before = F.coalesce(F.sum(F.col("high") - F.col("low")).over(by_query.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumns({"_low": F.sum("low").over(by_query), "_before": before})
    rise = (F.col("_low") + F.col("_before") < wanted) | (F.col("top") == deepest)
    return both.select("id", "tree", "code", F.when(rise, F.col("top")).otherwise(F.col("top") + 1).alias("level"))


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores, the smaller id first where they are equal."""
    places = np.arange(len(scores))
    if len(scores) > most:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return places[np.lexsort((ids[places], -scores[places]))][:most]


def compared(key: tuple, rows: pa.Table, queries: pa.Table, most: int) -> pa.Table:
    """A block's best rows for each of its queries: ``query, id, score``."""
    out: tuple[list, list, list] = ([], [], [])
    if rows.num_rows and queries.num_rows:
        code, ids = rows.column("code").to_numpy(), rows.column("id").to_numpy()
        order = np.lexsort((ids, code))
        code, ids, x = code[order], ids[order], _matrix(rows.column("vector"))[order]
        shift = BITS - queries.column("level").to_numpy().astype(np.int64)
        prefix = queries.column("code").to_numpy() >> shift
        low = np.searchsorted(code, prefix << shift)
        high = np.searchsorted(code, (prefix + 1) << shift)
        name, q = queries.column("id").to_numpy(), _matrix(queries.column("vector"))
        spans, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
        for k, (a, b) in enumerate(spans):
            mine = np.flatnonzero(which.reshape(-1) == k)
            for some in np.array_split(mine, -(-len(mine) // 256)):
                scores = q[some] @ x[a:b].T
                for i, s in zip(some, scores):
                    best = _best(s, ids[a:b], most)
                    out[0].append(np.full(len(best), name[i]))
                    out[1].append(ids[a:b][best])
                    out[2].append(s[best])
    flat = [np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table({"query": pa.array(flat[0]), "id": pa.array(flat[1]), "score": pa.array(flat[2])})


def nearest(
    rows: DataFrame, queries: DataFrame, most: int = 20, share: float = SHARE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, key, score``: for the keys in column ``key`` of ``queries``, the
    rows of the largest inner products found, their own key left out.

    Vectors that are null, zero, not finite throughout, or not of the most common
    length take no part, nor do null keys. Equal vectors are compared once; equal
    scores rank by key. Repeated rows count once. Tables of up to 512 different
    vectors are compared whole. Other columns are not read.
    """
    named = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    named = named.where(F.col("key").isNotNull() & usable(F.col("vector")))
    common = named.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        none = f"query_id bigint, rank int, `{key}` bigint, score double"
        return rows.sparkSession.createDataFrame([], none)
    vectors, members = classes_of(named.where(F.size("vector") == common["dim"]))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total = vectors.agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).first()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    hashes = Hashes(_matrix(sample.column("vector")), total["longest"])

    own = max(0, math.ceil(math.log2(total["n"] / BLOCK)))
    deepest = min(BITS, own + LEVELS)
    asked = queries.select(F.col(key).cast("bigint").alias("key")).distinct()
    asking = materialise(members.join(asked, "key").select("id", F.col("key").alias("query_id")))
    index = hashed(vectors, hashes, False)
    index = materialise(index.select("id", "vector", F.posexplode("hashes").alias("tree", "code")))
    counts = index.groupBy("tree", _prefix(F.col("code"), deepest).alias("_p")).agg(F.count("*").alias("_n"))
    counts = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    up = F.call_function("shiftright", F.col("_p"), (F.lit(deepest) - F.col("level")).cast("int"))
    counts = materialise(counts.groupBy("tree", "level", up.alias("prefix")).agg(F.sum("_n").alias("n")))

    who = vectors.join(asking.select("id").distinct(), "id", "left_semi")
    coded = materialise(hashed(who, hashes, True))
    wanted = math.ceil(max(share * total["n"], TREES * min(total["n"], ALL)))
    levels = levels_of(coded, counts, wanted, deepest)
    # Blocks by the first bits; large ones, of vectors that are close together, are dealt by id.
    block = counts.where(F.col("level") == own).select("tree", F.col("prefix").alias("block"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rounds = max(1, math.ceil(who.count() / QUERIES))
    rows_in = index.withColumn("block", _prefix(F.col("code"), own)).join(block, ["tree", "block"])
    rows_in = rows_in.withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")), "round": F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))})
    span = F.greatest(F.lit(own) - F.col("level"), F.lit(0)).cast("int")
    first = F.call_function("shiftleft", F.call_function("shiftright", _prefix(F.col("code"), own), span), span)
    last = first + F.call_function("shiftleft", F.lit(1).cast("bigint"), span) - 1
    routed = levels.withColumn("block", F.explode(F.sequence(first, last))).join(block, ["tree", "block"])
    routed = routed.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)), "round": F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int")})
    routed = routed.join(coded.select("id", "vector"), "id")
    by = ["tree", "block", "part", "round"]

    def run(group, left, right):
        return compared(group, left, right, most + 1)

    met = rows_in.select(*by, "id", "code", "vector").groupBy(*by).cogroup(
        routed.select(*by, "id", "code", "level", "vector").groupBy(*by)
    ).applyInArrow(run, "query bigint, id bigint, score double")
    found = met.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = materialise(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most + 1).drop("_r"))
    discard(index, coded, counts)
    # A class stands for its smallest keys; one more than asked for, as a query's own goes.
    few = Window.partitionBy("id").orderBy("key")
    first_keys = members.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= most + 1).drop("_r")
    # A query's own class is met first in each tree; queries of one vector share what was found.
    pairs = found.join(first_keys, "id").select("query", "key", "score")
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    pairs = pairs.withColumn("_r", F.row_number().over(by_class)).where(F.col("_r") <= most + 1).drop("_r")
    answers = asking.join(pairs, asking["id"] == pairs["query"]).where("key != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score")


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
