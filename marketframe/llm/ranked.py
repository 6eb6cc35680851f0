"""Exact lexical top lists: impact vectors in order of their length, bucket by bucket.

A document's impact vector has a coordinate for each term that some query holds, and
a query counts its terms; the score is their product. Vectors lie in order of their
length (Teflioudi and others, LEMP, 2015). Rounds go from the longest to shorter ones,
each with the scores that the rounds before have reached: where the product of
lengths stays below, a whole bucket falls; inside a bucket the heaviest coordinates
bound each document's score; what is left is scored again in whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks, data, table, text_bytes
from .words import _LOWER, hash_spans, spans

TOP = 10
#: Length normalisation in percent, and the scale of weights.
SLOPE, SCALE = 75, 1000

#: Terms of the queries that one pass over the documents takes.
QUERY_TERMS = 1 << 16
#: Documents of the first round at least, and how many times more each next one takes.
FIRST, GROWTH = 2000, 16
#: Buckets of vectors whose lengths double.
BUCKETS = 4

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Stands for a null key where ties are broken.
LAST = np.iinfo(np.int64).max


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all terms, and where each row's terms start (one more than rows)."""
    start, end = spans(_TERM[buf], off)
    return hash_spans(_LOWER[buf], start, end) >> np.uint64(1), np.searchsorted(start, off)


@dataclass
class Queries:
    """Queries of one pass: for each its terms' numbers in ``vocabulary`` and their counts."""

    items: list
    vocabulary: np.ndarray
    places: list[np.ndarray]
    counts: list[np.ndarray]


def _counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        buf = np.frombuffer(text, np.uint8)
        h, _ = terms(buf, np.array([0, len(buf)]))
        out.append(np.unique(h, return_counts=True))
    return out


def query_blocks(queries: DataFrame, key: str, text: str, most: int = QUERY_TERMS):
    """The queries in blocks of at most ``most`` words, or of one longer query."""
    rows = queries.select(F.col(key).alias("item"), text_bytes(text).alias("text"))
    # Two terms are at least three bytes.
    rows = rows.withColumn("size", F.ceil((F.octet_length("text") + 1) / 2))
    parts, total = 1, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    while parts * most < total * 2:
        parts *= 2
    dealt = lambda: F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    while rows.groupBy(dealt()).agg(F.sum("size").alias("size"), F.count_distinct("item", "text").alias("n")).where(f"size > {most} AND n > 1").count():
        parts *= 2
    for part in range(parts):
        block = rows.where(dealt() == part).collect()
        block.sort(key=lambda r: (r.item is None, r.item, r.text))
        found = _counted([r.text for r in block])
        vocabulary = np.unique(np.concatenate([f[0] for f in found])) if found else np.empty(0, np.uint64)
        places = [np.searchsorted(vocabulary, f[0]) for f in found]
        yield Queries([r.item for r in block], vocabulary, places, [f[1] for f in found])


def term_vectors(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, term, tf``: how many terms each document has, and those of the
    vocabulary, by number, with their frequencies."""

    def run(batches):
        for part in chunks(batches, "text"):
            h, first = terms(*data(part.column("text")))
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
            known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
            pair, tf = np.unique(row[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
            row, term = np.divmod(pair, max(len(vocabulary), 1))
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first).astype(np.int64)), *lists], names)

    names = ["doc_id", "n", "term", "tf"]
    return rows.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<int>")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    column = batch.column(name)
    off = np.asarray(column.offsets, np.int64)
    return off - off[0], np.asarray(column.flatten())


def impacts(vectors: DataFrame, weight: np.ndarray, documents: int, total: int) -> DataFrame:
    """``doc_id, bucket, norm, term, impact`` of the documents that hold a query's term.

    The impact leaves out the term's weight, the norm does not. Buckets fall with the norm.
    """

    def run(batches):
        for batch in batches:
            off, term = _lists(batch, "term")
            _, tf = _lists(batch, "tf")
            n = np.asarray(batch.column("n"))
            m = 100 - SLOPE + SLOPE * n * documents // max(total, 1)
            tf = tf.astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(off)))
            # Every row has a term. A little more than the length, so rounding drops nothing.
            norm = np.sqrt(np.add.reduceat((weight[term] * impact).astype(float) ** 2, off[:-1])) * (1 + 1e-9)
            keep = norm > 0
            bucket = np.floor(-BUCKETS * np.log2(np.where(keep, norm, 1.0))).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array(bucket), pa.array(norm), batch.column("term")]
            columns.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(impact.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    names = ["doc_id", "bucket", "norm", "term", "impact"]
    found = vectors.where(F.size("term") > 0)
    return found.mapInArrow(run, "doc_id bigint, bucket int, norm double, term array<int>, impact array<int>")


class Best:
    """The best documents found for one query."""

    def __init__(self, least: int):
        self.least, self.score, self.doc = least, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray, top: int) -> None:
        score, doc = np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score))[:top]
        self.score, self.doc = score[order], doc[order]
        if len(order) == top:
            self.least = max(self.least, int(self.score[-1]))


def search(vectors: DataFrame, queries: Queries, weight: np.ndarray, least: list[int], top: int) -> DataFrame:
    """``slot, score, doc_id``: what each task of the vectors' buckets has for each query (by
    its number), as far as it reaches ``least`` and is among the task's ``top``."""
    heavy = []
    for place, count in zip(queries.places, queries.counts):
        # The coordinates that bound a score inside a bucket: the heaviest half.
        order = np.argsort(-(weight[place] * count), kind="stable")
        half = (len(order) + 1) // 2
        heavy.append((place[order], count[order], half, math.sqrt(float((count[order][half:] ** 2).sum()))))
    length = [math.sqrt(float((c**2).sum())) * (1 + 1e-12) for c in queries.counts]

    def run(batches):
        best = [Best(x) for x in least]
        for batch in batches:
            off, term = _lists(batch, "term")
            _, impact = _lists(batch, "impact")
            norm, size = np.asarray(batch.column("norm")), batch.num_rows
            doc = np.asarray(batch.column("doc_id").fill_null(LAST))
            value = weight[term] * impact
            row = np.repeat(np.arange(size), np.diff(off))
            order = np.argsort(term, kind="stable")
            row, value = row[order], value[order]
            first = np.searchsorted(term[order], np.arange(len(weight) + 1))
            longest = float(norm.max(initial=0.0))
            peak = np.zeros(len(weight), np.int64)
            held = np.flatnonzero(np.diff(first))
            if len(held):
                peak[held] = np.maximum.reduceat(value, first[held])
            for q, (place, count, half, rest) in enumerate(heavy):
                mine = best[q]
                if not len(place) or length[q] * longest < mine.least:
                    continue  # the bucket
                score, square = np.zeros(size, np.int64), np.zeros(size)
                for t, c in zip(place[:half].tolist(), count[:half].tolist()):
                    at, x = row[first[t] : first[t + 1]], value[first[t] : first[t + 1]]
                    score[at] += c * x
                    square[at] += x.astype(float) ** 2
                left = np.minimum(rest * np.sqrt(np.maximum(norm**2 * (1 + 1e-12) - square, 0)), float((count[half:] * peak[place[half:]]).sum()))
                some = np.flatnonzero(score + left * (1 + 1e-9) >= mine.least)
                if not len(some):
                    continue
                for t, c in zip(place[half:].tolist(), count[half:].tolist()):
                    score[row[first[t] : first[t + 1]]] += c * value[first[t] : first[t + 1]]
                some = some[(score[some] >= mine.least) & (score[some] > 0)]
                mine.add(score[some], doc[some], top)
        slots = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        scores = np.concatenate([b.score for b in best]) if best else np.empty(0, np.int64)
        docs = np.concatenate([b.doc for b in best]) if best else np.empty(0, np.int64)
        columns = [pa.array(slots.astype(np.int32)), pa.array(scores), pa.array(docs)]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "score", "doc_id"])

    return vectors.mapInArrow(run, "slot int, score bigint, doc_id bigint")


def rounds(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of buckets, from the longest vectors on; each has about ``GROWTH`` times more rows."""
    out, start, rows, want = [], None, 0, FIRST
    for bucket, n in sorted(sizes):
        start = bucket if start is None else start
        rows += n
        if rows >= want:
            out.append((start, bucket))
            start, rows, want = None, 0, want * GROWTH
    return out if start is None else [*out, (start, max(b for b, _ in sizes))]


def _pass(rows: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``slot, rank, doc_id, score`` for one block of queries."""
    spark = rows.sparkSession
    vectors = materialise(term_vectors(rows, queries.vocabulary))
    total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    documents = total["documents"]
    weight = np.array([math.floor(SCALE * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    ordered = impacts(vectors, weight, documents, total["n"]).sortWithinPartitions("bucket", F.desc("norm"))
    lengths = materialise(ordered)
    discard(vectors)
    best = spark.createDataFrame([], "slot int, score bigint, doc_id bigint")
    least = [0] * len(queries.items)
    sizes = [(r.bucket, r["count"]) for r in lengths.groupBy("bucket").count().collect()]
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "doc_id")
    for low, high in rounds(sizes):
        found = search(lengths.where(F.col("bucket").between(low, high)), queries, weight, least, top)
        ranked = best.union(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        best, before = materialise(ranked.select("slot", "score", "doc_id")), best
        discard(before)
        for r in best.groupBy("slot").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == top).collect():
            least[r.slot] = r.least
    discard(lengths)
    return best.withColumn("rank", F.row_number().over(w)).select("slot", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def ranked_search(documents: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
                  query_key: str = "item_id", query_text: str = "text", most: int = QUERY_TERMS) -> DataFrame:
    """``query_key, rank, key, score``: each query's best documents, with a score above 0.

    A null or empty text, or one without terms, is no document and as a query finds
    nothing. Repeated rows are documents, or queries, each. Equal scores rank by key,
    null keys last. Texts are read whole, at any length, and all documents count; the
    queries are taken in blocks of ``most`` terms, each one pass. Other columns are not
    read; empty tables give an empty result. Terms are compared by 63-bit hashes.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), text_bytes(text).alias("text"))
    kind = queries.schema[query_key].dataType
    out = None
    for block in query_blocks(queries, query_key, query_text, most):
        names = rows.sparkSession.createDataFrame(list(enumerate(block.items)), f"slot int, item {kind.simpleString()}")
        found = _pass(rows, block, top).join(F.broadcast(names), "slot")
        found = found.select(F.col("item").alias(query_key), "rank", F.col("doc_id").alias(key), "score")
        out = found if out is None else out.union(found)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

SQL = f"""WITH words AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_TERMS} AS terms FROM documents),
docs AS (SELECT doc_id, r, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, floor({SCALE} * ln((2 * (SELECT n FROM total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {SLOPE} + ({SLOPE} * d.n * z.n) // z.l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs d USING (r) CROSS JOIN total z GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
