"""MinHash near-duplicates by an inverted join of signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks, data, table, text_bytes
from .jaccard import SQL_WORDS, _signature
from .stars import counter, groups, inside, rarity, verified
from .words import mix, shingle_sets

WORDS = 2
#: Two documents link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 80, 100

#: Coordinates of a signature, and how many of them two documents must share. Of two sets
#: that are just similar enough, 51 agree on average; fewer than 36 do with a chance
#: of 1 in 100,000, and the more alike, the rarer still.
COORDINATES, MATCHES = 64, 36

#: Shared coordinates that are counted for; so many more than it takes to find one are posted.
COUNTED = 3
POSTED = COORDINATES - MATCHES + COUNTED

_NUMBER = np.arange(1, COORDINATES + 1, dtype=np.uint64)
_TIMES = mix(_NUMBER * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLUS = mix(_NUMBER + np.uint64(0xD1B54A32D192ED03))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none of them empty) and coordinate 32 bits of the smallest hash."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    if not len(sets):
        return out
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    for j in range(COORDINATES):
        out[:, j] = mix(np.minimum.reduceat(flat * _TIMES[j] + _PLUS[j], start)) >> np.uint64(32)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """One key for each coordinate and value."""
    return ((_NUMBER << np.uint64(32)) | signature.astype(np.uint64)).view(np.int64)


def _set_of_text(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(*data(batch.column("text")), WORDS)


def signed(rows: DataFrame) -> DataFrame:
    """``doc_id, n, s1, s2, signature`` of each document's set; zeros and null for empty ones."""

    def run(batches):
        for part in chunks(batches, "text", 1 << 20):
            sets = _set_of_text(part)
            full = [i for i, x in enumerate(sets) if len(x)]
            signs = signatures([sets[i] for i in full])
            column = np.full(len(sets), None, object)
            for i, s in zip(full, signs):
                column[i] = s.tobytes()
            both = [_signature(x) if len(x) else (0, 0) for x in sets]
            columns = [part.column(0), pa.array([len(x) for x in sets], pa.int32())]
            columns += [pa.array([b[k] for b in both], pa.int64()) for k in (0, 1)] + [pa.array(column.tolist(), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n", "s1", "s2", "signature"]
    return rows.mapInArrow(run, "doc_id bigint, n int, s1 bigint, s2 bigint, signature binary")


def _signatures_in(batch: pa.RecordBatch) -> np.ndarray:
    buf, _ = data(batch.column("signature"))
    return buf.view(np.uint32).reshape(-1, COORDINATES)


def posted(classes: DataFrame) -> DataFrame:
    """``id, size, low, high, keys``: the rarest coordinates of each class as keys, and two
    bits of every coordinate."""
    often = rarity(classes.select("signature"), lambda batch: keys_of(_signatures_in(batch)).ravel())

    def run(batches):
        for batch in batches:
            signs = _signatures_in(batch)
            keys = keys_of(signs)
            order = np.argsort(often[counter(keys)], axis=1, kind="stable")[:, :POSTED]
            flat = np.take_along_axis(keys, order, 1).ravel()
            ends = pa.array((np.arange(len(signs) + 1) * POSTED).astype(np.int32))
            bits = [np.packbits((signs >> np.uint32(k)) & np.uint32(1), axis=1, bitorder="little") for k in (0, 1)]
            columns = [batch.column("id"), batch.column("n"), *[pa.array(np.ascontiguousarray(b).view(np.int64)[:, 0]) for b in bits]]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(flat))], names)

    names = ["id", "size", "low", "high", "keys"]
    return classes.mapInArrow(run, "id bigint, size int, low bigint, high bigint, keys array<bigint>")


def fits(x: Column, y: Column) -> Column:
    """Whether sizes allow a link, and no more coordinates are known to differ than may.

    Where two bits of a coordinate differ, it does; so no pair with enough matches falls.
    """
    differ = F.bit_count(x["low"].bitwiseXOR(y["low"]).bitwiseOR(x["high"].bitwiseXOR(y["high"])))
    sizes = F.least(x["size"], y["size"]) * DEN >= F.greatest(x["size"], y["size"]) * NUM
    return sizes & (differ <= COORDINATES - MATCHES)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * DEN < max(len(x), len(y)) * NUM:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row.

    Documents with one set are a class. A class posts the rarest ``POSTED`` of its
    signature's coordinate-value pairs: two signatures with ``MATCHES`` coordinates in
    common have ``COUNTED`` of them among those, whatever order both take. Long lists are
    so left out, and are only looked at through the bits each posting carries. Pairs
    that reach the count are held against their whole sets.

    A null or empty text, or one without words, has an empty set and is kept. Equal
    texts are linked through their class, repeated rows included. Keys are taken for
    unique: rows with one key are one node. Rows with a null key get their class's
    component and are never the kept one. Texts are whole, however long; an empty table
    gives an empty result; other columns are not read.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("id"), text_bytes(text).alias("text"))
    sets = materialise(signed(rows))
    by = ["n", "s1", "s2"]
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*by).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = materialise(classes)
    nodes = materialise(posted(classes.select("id", "n", "signature")))
    found = groups(
        nodes, fits, lambda pairs: verified(pairs, rows, _set_of_text, similar), COUNTED,
        within=lambda near: inside(near, rows, _set_of_text, NUM, DEN),
    )
    discard(nodes)
    named = classes.select("id", *by).join(found.hint("merge"), "id", "left").select(*by, F.coalesce("component", "id").alias("component"))
    out = sets.select("doc_id", *by).join(named.hint("merge"), by, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        F.col("doc_id").alias(key), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = f"""WITH RECURSIVE split AS (SELECT doc_id, {SQL_WORDS} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + {WORDS - 1}], ' ')) AS shingle
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
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
