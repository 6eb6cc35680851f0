"""Connected groups of linked rows, and bitmaps that pick rows by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

#: Words of a bitmap of keys. It has at most so many rows, so it may be broadcast.
BITMAP = 1 << 18


def marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with column ``_maybe``: false only where ``key`` is not in column ``id`` of ``ids``.

    A bitmap of the ids' hashes, of bounded size, is met where rows are read. So text
    that no id asks for is not shuffled to a join; as the ids become many, more rows
    pass, and the join behind it decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP * 64))
    word, mask = (lambda b: F.shiftrightunsigned(b, 6)), (lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int")))
    bits = ids.select(bit(F.col("id")).alias("_bit")).distinct()
    bitmap = bits.groupBy(word(F.col("_bit")).alias("_word")).agg(F.bit_or(mask(F.col("_bit"))).alias("_bits"))
    met = rows.withColumn("_word", word(bit(F.col(key)))).join(F.broadcast(bitmap), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask(bit(F.col(key)))) != 0, F.lit(False))
    return met.select(*rows.columns, maybe.alias("_maybe"))


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in column ``id`` of ``ids``."""
    exact = ids.select(F.col("id").alias(key)).distinct()
    return marked(rows, ids, key).where("_maybe").drop("_maybe").join(exact.hint("merge"), key, "left_semi")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of all nodes of ``links`` (``a, b``); the smallest id names a group.

    Each round every node goes to that of its neighbours and itself with the smallest
    hash, another one each round, and on to where that one goes; links whose ends are
    one node then are dropped. So a round leaves a fraction of the nodes whatever
    their order, groups that are done take no further part, and all rounds together
    read a few times the links. Hubs are met by grouped minima with map-side
    combine. Rounds are written to shared storage; only a count reaches the driver.
    """
    edges, rounds = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while not rounds or not edges.isEmpty():
        turn = F.lit(len(rounds))
        ranked = lambda c: F.struct(F.xxhash64(turn, c), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("id")).agg(F.min(ranked("b")).alias("_low"))
        goes = materialise(lowest.select("id", F.least("_low", ranked("id")).getField("id").alias("root")))
        end = goes.select(F.col("id").alias("root"), F.col("root").alias("_end"))
        rounds.append(materialise(goes.join(end, "root").select("id", F.col("_end").alias("root"))))
        to = lambda side: rounds[-1].select(F.col("id").alias(side), F.col("root").alias(f"_{side}"))
        ends = edges.join(to("a"), "a").join(to("b"), "b").where("_a != _b")
        after = materialise(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        discard(edges, goes)
        edges = after
    # Back from the last round, which has the fewest nodes.
    found = rounds[-1]
    for before in reversed(rounds[:-1]):
        later = found.select(F.col("id").alias("root"), F.col("root").alias("_end"))
        found = before.join(later, "root", "left").select("id", F.coalesce("_end", "root").alias("root"))
    found = materialise(found)
    names = found.groupBy("root").agg(F.min("id").alias("component"))
    labels = materialise(found.join(names, "root").select("id", "component"))
    discard(edges, found, *rounds)
    return labels


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """``id, component`` once the links ``more`` (``a, b``) join components of ``found``."""
    end = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
    ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
    ends = materialise(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a != b"))
    if ends.isEmpty():
        return found
    joined = components(ends)
    new = joined.select("id").join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    names = joined.select(F.col("id").alias("component"), F.col("component").alias("_name"))
    both = found.select("id", "component").union(new).join(names, "component", "left")
    return both.select("id", F.coalesce("_name", "component").alias("component"))
