"""Cross-entropy difference of documents under a target and a background model.

Both are interpolated bigram models over one vocabulary, all words of the corpus (Moore
and Lewis 2010). They match: same order, same smoothing, and the background's counts are
scaled to the target's size. A document's own words are taken out of both before it is
scored, so its score says what it is like and not whether it was counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks, data, table, text_bytes
from .jaccard import SQL_WORDS
from .words import mix, words

WEIGHT = 0.7

#: Bytes of text of a block of documents, of the part of it that is counted at once, and of what
#: has the keys of one range.
BLOCK, PART, RANGE = 24 << 20, 2 << 20, 4 << 20

#: What stands before a row's first word.
START = np.uint64(0x5354415254)
#: Keys of words, of words with another behind them, and of pairs: by the two lowest bits.
WORD, PAST, PAIR = 0, 1, 2


def _keyed(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) & ~np.uint64(3)) | np.uint64(kind)


def token_keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of column ``text``: its row, and its three keys; and rows' sizes."""
    w, first = words(*data(part.column("text")))
    size = np.diff(first)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first[:-1][size > 0]] = START
    keys = np.stack([_keyed(w, WORD), _keyed(before, PAST), _keyed(before + mix(w), PAIR)])
    return np.repeat(np.arange(len(size)), size), keys, size


def own_counts(row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each token's row has its key."""
    pairs = mix(keys + mix(row.astype(np.uint64) + np.uint64(1)))
    _, back, n = np.unique(pairs, return_inverse=True, return_counts=True)
    return n[back]


def places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys, looked up in order, stand in ``known``."""
    order, at = np.argsort(keys), np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(known, keys[order])
    return at


def _parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    return chunks(rows.select(["doc_id", "text"]).combine_chunks().to_batches(), "text", PART)


def _targets(marks: pa.Table) -> np.ndarray:
    keys = marks.filter(pc.is_valid(marks.column("doc_id"))).column("doc_id").to_numpy()
    return np.unique(keys)


def _is_target(part: pa.RecordBatch, targets: np.ndarray) -> np.ndarray:
    keys = part.column("doc_id")
    return np.isin(keys.fill_null(0).to_numpy(zero_copy_only=False), targets) & np.asarray(keys.is_valid())


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest of all first, up to the highest that is not 0."""
    rows = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return rows[: int(rows.any(axis=1).nonzero()[0].max(initial=-1)) + 1].tobytes()


def unplaned(raw: bytes, n: int) -> np.ndarray:
    rows = np.zeros((8, n), np.uint8)
    if n:
        rows[: len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(rows.T).view(np.uint64)[:, 0]


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def counted(rows: pa.Table, marks: pa.Table, bits: int) -> pa.Table:
    """``range, block, size, keys, n, t`` of one block: its different keys in order, cut by their
    highest ``bits``; how often they occur, and how often in documents of the target."""
    targets, found, many = _targets(marks), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for part in _parts(rows):
        row, keys, _ = token_keys(part)
        # Both counts in one number, so that fewer arrays stand side by side.
        both = 1 + (_is_target(part, targets)[row].astype(np.int64) << 32)
        for kind in keys:
            for x, y in zip((found, many), _summed(kind, both)):
                x.append(y)
    found, many = np.concatenate(found), np.concatenate(many)
    key, both = _summed(found, many)
    del found, many
    n, t = both & 0xFFFFFFFF, both >> 32
    block, out = rows.column("block")[0].as_py() if len(rows) else 0, []
    for k, a, e in ranges(key, bits):
        out.append((k, block, e - a, planes(np.diff(key[a:e], prepend=np.uint64(0))), planes(n[a:e]), planes(t[a:e])))
    return pa.Table.from_pylist([dict(zip(COUNTED.names, x)) for x in out], COUNTED)


def ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """The ranges that keys in order have, by their highest bits, with their starts and ends."""
    of = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    yield from zip(of[starts].tolist(), starts.tolist(), np.append(starts[1:], len(of)).tolist())


def gathered(rows: pa.Table) -> pa.Table:
    """``block, range, size, n, t`` of one range: for the keys of each block, in their order, the counts
    of all blocks; and, without a block, ``word, all_n, all_t`` of each of its words."""
    parts = rows.to_pylist()
    keys = [np.cumsum(unplaned(x["keys"], x["size"]), dtype=np.uint64) for x in parts]
    counts = [np.concatenate([unplaned(x[c], x["size"]).astype(np.int64) for x in parts]) for c in "nt"]
    different, *sums = _summed(np.concatenate(keys), *counts)
    word, out = different & np.uint64(3) == WORD, []
    for x, mine in zip(parts, keys):
        at = np.searchsorted(different, mine)
        out.append({"block": x["block"], "range": x["range"], "size": len(mine), **{c: planes(s[at]) for c, s in zip("nt", sums)}})
    columns = {"word": different[word].view(np.int64), **{f"all_{c}": s[word] for c, s in zip("nt", sums)}}
    words = pa.table([pa.array(columns[c]) if c in columns else pa.nulls(int(word.sum()), GATHERED.field(c).type) for c in GATHERED.names], GATHERED)
    return pa.concat_tables([pa.Table.from_pylist(out, GATHERED), words])


COUNTED = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), *[(c, pa.binary()) for c in ("keys", "n", "t")]])
GATHERED = pa.schema([("block", pa.int32()), ("range", pa.int32()), ("size", pa.int32()), ("n", pa.binary()), ("t", pa.binary()), *[(c, pa.int64()) for c in ("word", "all_n", "all_t")]])


def blocks_of(rows: DataFrame) -> tuple[DataFrame, Column, int]:
    """The rows ``doc_id, text`` with their block, what gives the block of a key, and the bits of
    ranges of keys. Keys are dealt, rows without a key by their text; a block has ``BLOCK`` bytes on average."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = F.lit(size // BLOCK + 1)
    of = lambda c: F.pmod(F.xxhash64(c), many).cast("int")
    by_text = F.when(F.col("doc_id").isNull(), of("text")).otherwise(of("doc_id"))
    return rows.withColumn("block", by_text), of("doc_id"), int(size // RANGE).bit_length()


def cross_entropy_difference(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, target_loss, background_loss, score`` of every document: mean loss per
    word under both models and their difference.

    ``target`` has the keys of the target corpus in column ``key`` (repeats and nulls
    do no harm); the background is all documents. The lower the score, the more a
    document is like the target's others. All words and bigrams of all documents count,
    in tables that grow with the corpus. Documents are dealt into blocks; a block
    sends each of its different words and bigrams once, as ranges of sorted hashes with
    their counts, and gets back the counts of all blocks in the same order, without the
    hashes, which it makes again from its texts when it is scored.

    A null or empty text, or one without words, has no words and null losses. Repeated
    rows count and are scored each, with their own row taken out; with an empty target
    its model is uniform. Texts are whole, however long; an empty table gives an empty
    result. Other columns are not read.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), text_bytes(text).alias("text"))
    rows, block, bits = blocks_of(rows)
    marks = target.select(F.col(key).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("block", block)
    texts = rows.groupBy("block")
    sent = texts.cogroup(marks.groupBy("block")).applyInArrow(
        lambda rows, marks: counted(rows, marks, bits), "range int, block int, size int, keys binary, n binary, t binary"
    )
    kinds = "block int, range int, size int, n binary, t binary, word bigint, all_n bigint, all_t bigint"
    asked = materialise(sent.groupBy("range").applyInArrow(gathered, kinds))
    known = materialise(asked.where("word IS NOT NULL").select(F.col("word").alias("key"), "all_n", "all_t"))
    total = known.agg(*[F.coalesce(F.sum(f"all_{c}"), F.lit(0)).alias(c) for c in "nt"], F.count("*").alias("words")).first()
    signs = total["words"] + 1
    discard(known)
    no = F.lit(None)
    given = asked.where("block IS NOT NULL").select("block", "range", "size", "n", "t", no.cast("bigint").alias("doc_id"))
    given = given.union(marks.select("block", no.cast("int"), no.cast("int"), no.cast("binary"), no.cast("binary"), "doc_id"))

    def scored(rows: pa.Table, given: pa.Table) -> pa.Table:
        targets = _targets(given)
        model = given.filter(pc.is_valid(given.column("range"))).sort_by("range").to_pylist()
        (known,) = _summed(np.concatenate([np.empty(0, np.uint64), *[_summed(token_keys(part)[1].ravel())[0] for part in _parts(rows)]]))
        if [(x["range"], x["size"]) for x in model] != [(k, e - a) for k, a, e in ranges(known, bits)]:
            raise ValueError("the documents changed while they were read")
        counts = [np.concatenate([np.empty(0), *[unplaned(x[c], x["size"]).astype(float) for x in model]]) for c in "tn"]
        out = []
        for part in _parts(rows):
            row, keys, size = token_keys(part)
            mine = _is_target(part, targets)
            at = np.stack([places(known, kind) for kind in keys])
            own = np.empty(keys.shape)
            for k, kind in enumerate(keys):
                own[k] = own_counts(row, kind)
            left = [np.maximum(total[c] - size * (mine if c == "t" else 1), 0)[row] for c in "tn"]
            scale = left[0] / np.maximum(left[1], 1)
            means = []
            for c, n, own_c, times in zip("tn", counts, (own * mine[row], own), (1.0, scale)):
                word, past, pair = n[at] - own_c
                unigram = (word * times + 1) / (left[0] + signs)
                p = np.where(past > 0, WEIGHT * pair / np.maximum(past, 1) + (1 - WEIGHT) * unigram, unigram)
                means.append(np.bincount(row, -np.log(p), len(size)) / np.maximum(size, 1))
            none = size == 0
            columns = [part.column(0), pa.array(size.astype(np.int64)), *[pa.array(x, mask=none) for x in (*means, means[0] - means[1])]]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in names[2:]]])
        return pa.Table.from_batches(out, schema)

    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    kinds = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"
    out = materialise(texts.cogroup(given.groupBy("block")).applyInArrow(scored, kinds))
    discard(asked)
    return out.withColumnRenamed("doc_id", key)


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what ``labels`` marks as good; figures to six decimals."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    out = cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def _sql_loss(n: str, own: str, times: str) -> str:
    unigram = f"(((u.{n} - o.w * {own}) * {times} + 1) / (rest_t + signs))"
    past = f"(p.{n} - o.h * {own})"
    return f"""-ln(CASE WHEN {past} > 0 THEN {WEIGHT}::DOUBLE * (b.{n} - o.p * {own}) / {past} + (1 - {WEIGHT}::DOUBLE) * {unigram}
      ELSE {unigram} END)"""


SQL = f"""WITH split AS (
  SELECT row_number() OVER () AS r, d.doc_id, {SQL_WORDS} AS words,
    (d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS target FROM documents d),
tokens AS (SELECT r, target, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
pairs AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), ' ') AS h FROM tokens),
unigrams AS (SELECT w, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS t FROM pairs GROUP BY w),
past AS (SELECT h, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS t FROM pairs GROUP BY h),
bigrams AS (SELECT h, w, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS t FROM pairs GROUP BY h, w),
size AS (SELECT count(*) + 1 AS signs, sum(n) AS n, sum(t) AS t FROM unigrams),
own AS (
  SELECT r, target, h, w, count(*) OVER (PARTITION BY r, w)::DOUBLE AS ow, count(*) OVER (PARTITION BY r, h)::DOUBLE AS oh,
    count(*) OVER (PARTITION BY r, h, w)::DOUBLE AS op, count(*) OVER (PARTITION BY r)::DOUBLE AS len FROM pairs),
o AS (
  SELECT r, target, x.h, x.w AS word, ow AS w, oh AS h_own, op AS p, signs,
    greatest(z.t - len * target, 0) AS rest_t, greatest(z.t - len * target, 0) / greatest(z.n - len, 1) AS scale
  FROM own x CROSS JOIN size z),
losses AS (
  SELECT r, {_sql_loss('t', 'o.target', '1').replace('o.h *', 'o.h_own *')} AS t, {_sql_loss('n', '1', 'scale').replace('o.h *', 'o.h_own *')} AS n
  FROM o JOIN unigrams u ON u.w = o.word JOIN past p ON p.h = o.h JOIN bigrams b ON b.h = o.h AND b.w = o.word),
means AS (SELECT r, avg(t) AS target_loss, avg(n) AS background_loss FROM losses GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(target_loss, 6) AS target_loss, round(background_loss, 6) AS background_loss,
       round(target_loss - background_loss, 6) AS score
FROM split LEFT JOIN means USING (r)"""
