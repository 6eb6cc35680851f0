"""Document quality from random-indexing word vectors and a small network.

A token's index vector is sparse and comes from its hash. Its context vector is the
sum of the index vectors around it in a bounded sample of labelled documents. A
document is the mean context vector of its known tokens, the mean index vector of all,
and how alike its vectors are. A network of two layers scores it, with a temperature fitted on rows of the
sample that the network did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, data, table, text_bytes, unused
from .words import hash_spans, mix

WIDTH, NONZERO, AROUND, ECHOES = 64, 4, 2, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 64, 3e-3, 1e-3
THRESHOLD = 0.7

#: Bounds of the fit: labelled rows (those of the smallest hashes of their keys), bytes
#: of a row that may be among them, and tokens that get a context vector.
SAMPLE, SAMPLE_BYTES, VOCABULARY, LEAST_COUNT = 4000, 1 << 16, 1 << 15, 3

#: Tokens whose index vectors are made at once, and bytes of the sample that are split at once.
STEP, SPLIT = 1 << 18, 1 << 20

#: Classes of bytes: 0 for white space and controls, 1 for letters and digits, 2 for the rest.
_CLASS = np.full(256, 1, np.uint8)
_CLASS[:0x21] = 0
_CLASS[0x7F] = 0
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits and of the runs of other signs, as
    written, and where each row's begin (one more than rows)."""
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    kind = _CLASS[buf]
    new = np.empty(len(buf), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[off[:-1][off[:-1] < len(buf)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(buf))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return hash_spans(buf, start, end), np.searchsorted(start, off)


def index_parts(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the index vectors' entries."""
    h = mix(h + np.uint64(17))
    return [
        ((h >> np.uint64(8 * k) & np.uint64(WIDTH - 1)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(48 + k) & np.uint64(1)))
        for k in range(NONZERO)
    ]


def add_index(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sums of index vectors by row number."""
    total = np.zeros(n * WIDTH)
    for a in range(0, len(h), STEP):
        some = rows[a : a + STEP] * WIDTH
        for place, sign in index_parts(h[a : a + STEP]):
            total += np.bincount(some + place, sign, n * WIDTH)
    return total.reshape(n, WIDTH)


@dataclass
class WordVectors:
    known: np.ndarray
    context: np.ndarray

    @classmethod
    def fit(cls, h: np.ndarray, first: np.ndarray) -> WordVectors:
        values, counts = np.unique(h, return_counts=True)
        order = np.lexsort((values, -counts))[:VOCABULARY]
        known = np.sort(values[order[counts[order] >= LEAST_COUNT]])
        context = np.zeros((len(known), WIDTH))
        # Runs of whole rows, or a longer row by itself.
        cuts = np.unique(np.searchsorted(first, np.arange(0, len(h) + STEP, STEP)).clip(max=len(first) - 1))
        for lead, end in zip(cuts[:-1], cuts[1:]):
            some = h[first[lead] : first[end]]
            row = np.repeat(np.arange(end - lead), np.diff(first[lead : end + 1]))
            at = np.searchsorted(known, some)
            at[at == len(known)] = 0
            mine = known[at] == some if len(known) else np.zeros(len(some), bool)
            for step in range(1, AROUND + 1):
                near = row[step:] == row[:-step]
                for here, there in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                    use = near & mine[here]
                    context += add_index(at[here][use], some[there][use], len(known))
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        return cls(known, context.astype(np.float32))

    def pooled(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row's mean context vector of known tokens and mean index vector of all; their
        lengths, the logarithm of the number of tokens, and the shares of tokens whose
        vector is that of the one, two, three or four before (text that repeats itself)."""
        n = len(first) - 1
        count = np.maximum(np.diff(first), 1)[:, None]
        row = np.repeat(np.arange(n), np.diff(first))
        index = add_index(row, h, n) / count
        context, seen = np.zeros((n, WIDTH)), np.zeros(n)
        for a in range(0, len(h) if len(self.known) else 0, 1 << 15):
            some, of = h[a : a + (1 << 15)], row[a : a + (1 << 15)]
            at = np.searchsorted(self.known, some)
            at[at == len(self.known)] = 0
            hit = self.known[at] == some
            at, of = at[hit], of[hit]
            if len(at):
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                context[of[begin]] += np.add.reduceat(self.context[at], begin, axis=0)
                seen += np.bincount(of, minlength=n)
        context /= np.maximum(seen, 1)[:, None]
        shape = [np.linalg.norm(context, axis=1), np.linalg.norm(index, axis=1), np.log1p(np.diff(first)) / 8]
        for step in range(1, ECHOES + 1):
            same = (h[step:] == h[:-step]) & (row[step:] == row[:-step])
            shape.append(np.bincount(row[step:][same], minlength=n) / count[:, 0])
        return np.hstack([context, index, np.stack(shape, axis=1)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.centre) / self.spread @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        """Adam on the logistic loss over four fifths of the rows; the temperature has
        the least loss over the rest."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        net = cls(x[used].mean(0), x[used].std(0) + 1e-3, w)
        z = (x - net.centre) / net.spread
        one, two, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for a in range(0, len(used), BATCH):
                rows = used[a : a + BATCH]
                hidden = np.tanh(z[rows] @ w[0] + w[1])
                error = (_sigmoid(hidden @ w[2] + w[3]) - y[rows]) / len(rows)
                back = np.outer(error, w[2]) * (1 - hidden**2)
                slopes = [z[rows].T @ back + DECAY * w[0], back.sum(0), hidden.T @ error + DECAY * w[2], error.sum(keepdims=True)]
                step += 1
                for p, g, m, v in zip(w, slopes, one, two):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(held):
            raw, t = net.logits(x[held]), np.geomspace(0.5, 16, 81)
            loss = [np.logaddexp(0, np.where(y[held] > 0, -raw, raw) / k).sum() for k in t]
            net.temperature = float(t[int(np.argmin(loss))])
        return net


@dataclass
class QualityModel:
    """Without labels of both kinds, ``network`` is None and every score is ``prior``."""

    words: WordVectors
    network: Network | None
    prior: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(off) - 1, self.prior)
        return self.network.scores(self.words.pooled(*tokens(buf, off)))


def is_held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the key's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    A key with several labels counts as 0 if any is 0; null keys and labels are left
    out. The sample is at most ``SAMPLE`` rows of ``SAMPLE_BYTES``, so it fits the driver.
    """
    usable = labels.where(~is_held_out(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    rated = usable.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = rated.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)
    short = documents.select(F.col(key).alias("_key"), text_bytes(text).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    found = short.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"]).orderBy("_key").limit(SAMPLE).select("_label", "_text")
    sample = found.toArrow()
    y = sample.column("_label").to_numpy().astype(float)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return QualityModel(WordVectors(np.empty(0, np.uint64), np.empty((0, WIDTH), np.float32)), None, prior)
    # In parts: what stands beside the sample in the driver's memory stays small.
    parts = [tokens(*data(part.column("_text"))) for part in chunks(sample.to_batches(), "_text", SPLIT)]
    h = np.concatenate([part for part, _ in parts])
    first = np.cumsum([0, *np.concatenate([np.diff(at) for _, at in parts])])
    words = WordVectors.fit(h, first)
    return QualityModel(words, Network.fit(words.pooled(h, first), y), prior)


def score(documents: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, and ``score`` (0 to 1, whole texts).

    A null text is scored as an empty one, from all-zero vectors. Repeated rows and
    null keys are scored like any other. An input column ``score`` is replaced; other
    columns may have any name. Texts may be of any length; no rows give no rows.
    """
    columns = [c for c in documents.columns if c != "score"]
    raw = unused("text", columns)
    rows = documents.select(*[F.col(f"`{c}`") for c in columns], text_bytes(text).alias(raw))

    def run(batches):
        for part in chunks(batches, raw, 1 << 20):
            values = pa.array(model.scores(*data(part.column(raw))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(columns))], values], names)

    names = [*columns, "score"]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
