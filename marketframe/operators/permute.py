"""Keyed permutations of columns over a distributed table, without a sort."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

ROUNDS = 4


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written once, with ``_i`` from 0 on, and how many there are. Tasks number their
    own rows; one count per task says where each starts."""
    place = F.monotonically_increasing_id()
    rows = materialise(df.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return rows.join(starts, "_part").withColumn("_i", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), n


def permuted_number(i: Column, n: int, seed: int = 42) -> Column:
    """The place of ``i`` in a keyed permutation of 0 to n - 1.

    A Feistel network permutes the numbers of an even count of bits; a result that is n or
    more is permuted again, so after a few goes it is below.
    """
    half = max((n - 1).bit_length() + 1, 2) // 2
    mask, rng = (1 << half) - 1, random.Random(seed)
    keys = [rng.getrandbits(31) for _ in range(ROUNDS)]

    def network(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for key in keys:
            mixed = F.xxhash64(right, F.lit(key)).bitwiseAND(F.lit(mask))
            left, right = right, left.bitwiseXOR(mixed)
        return F.shiftleft(left, half).bitwiseOR(right)

    # Each go ends below n with a chance of a quarter at least.
    goes = F.sequence(F.lit(1), F.lit(200))
    start = F.struct(i.cast("bigint").alias("x"), F.lit(False).alias("done"))

    def go(state: Column, _: Column) -> Column:
        x = F.when(state["done"], state["x"]).otherwise(network(state["x"]))
        return F.struct(x.alias("x"), (state["done"] | (x < n)).alias("done"))

    return F.aggregate(goes, start, go, lambda s: s["x"])


def permuted(df: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """The rows with ``_permuted``, an array of the columns' values (as doubles) of another row:
    every row's values go to exactly one."""
    rows, n = numbered(df)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    moved = rows.select(permuted_number(F.col("_i"), n, seed).alias("_i"), values.alias("_permuted"))
    return rows.join(moved, "_i").drop("_i")
