"""From raw documents to training sequences, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
No stage reads a column beyond the five; a missing key (null ``doc_id``) or text is
kept as each operator's docstring says, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise
from marketframe.llm import fuzzy_lines, jaccard, packing, quality
from marketframe.llm.batches import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of rows
    that are not held out; without labels of both kinds nothing is rejected."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model.network is None:
        return docs
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, nearly alike, further up in the corpus; documents
    of which only white space is left go. ``n_chars`` is the length that is left."""
    left = fuzzy_lines.remove_lines(docs.select(*COLUMNS))
    gone = (F.col("_removed") > 0) & F.col("text").rlike(r"^\s*$")
    length = F.when(F.col("_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.where(~gone | F.col("text").isNull()).withColumn("n_chars", length).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies, the document of the smallest key. Rows with
    one key are one document; rows without a key all stay."""
    docs = docs.select(*COLUMNS)
    first = jaccard.near_copies(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where(F.col("doc_id").isNull()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their token ids."""
    return packing.pack(docs.select(*COLUMNS), with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_copies", keep_one_of_copies),
    ("packing", pack_sequences),
]

#: A trained network has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each hands on is a table on shared storage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
