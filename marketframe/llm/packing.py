"""Packing by power-of-two decomposition."""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import chunks, table, text_bytes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 1
SEQUENCE = 2048

#: Words with the spaces before them, cut off before ASCII punctuation. The tokenizer's
#: own splitting never joins two of these, as long as a text has no white space but the
#: four characters named here.
WORDS = re.compile(
    r"[ \n\t\r]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[!-&(-/:-@\[-`{-~])|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+"
)
OTHER_SPACE = re.compile(r"[^\S \n\t\r]")

#: Words of a generation. A worker remembers the ids of two: words seen since the last
#: change, and those of the time before.
GENERATION = 300_000


class Ids:
    """Ids of texts as little-endian 32-bit bytes; each different word is encoded once.

    Texts that hold an added token's content, or rare white space, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in coded]

    def of(self, texts: list[str]) -> list[bytes]:
        plain = [not (OTHER_SPACE.search(t) or any(a in t for a in self.added)) for t in texts]
        split = [WORDS.findall(t) if p else () for t, p in zip(texts, plain)]
        if len(self.words) > GENERATION:
            self.words, self.older = {}, self.words
        new = [w for w in set().union(*split) if w not in self.words]
        before = self.older.get
        self.words.update((w, ids) for w in new if (ids := before(w)) is not None)
        new = [w for w in new if w not in self.words]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.words.update(zip(some, self.encode(some)))
        known = self.words.__getitem__
        return [b"".join(map(known, s)) if p else self.encode([t])[0] for t, s, p in zip(texts, split, plain)]


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def binary_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Whole sequences first, then the powers of two that make up the rest, falling."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    df: DataFrame, tokenizer: str = TOKENIZER, most: int = SEQUENCE, with_ids: bool = False,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids and the end id are cut into pieces of ``most`` (a power of two)
    and the binary lengths of the rest. Each piece is a sequence of its own, so no
    sequence crosses documents and none has padding; sequences of one length form a
    bucket (``write_buckets``). The sequence id is a running number inside a
    task's share of the input, with the task's number in its upper bits: unique, and
    the same again when a lost task is repeated.

    A null or empty text is one piece with the end id; repeated rows and null keys
    are packed like any other; other columns of the input are not read. Texts are
    whole, however long; an empty table gives an empty result. ``with_ids`` adds the ids
    themselves.
    """

    def run(batches):
        end = np.asarray([END], "<u4").tobytes()
        for part in chunks(batches, "text", 1 << 20):
            texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            doc, start, length, crc, tokens, ids = [], [], [], [], [], []
            for row, coded in enumerate(ids_of(tokenizer).of(texts)):
                coded = memoryview(coded + end)
                at, n = 0, len(coded) // 4
                for size in binary_lengths(n, most):
                    piece = coded[4 * at : 4 * (at + size)]
                    doc.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    if with_ids:
                        ids.append(piece)
                    at += size
            columns = [part.column(0).take(pa.array(doc, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            if with_ids:
                ends = np.cumsum([0, *length]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    rows = df.select(F.col(key), text_bytes(text).alias("text"))
    pieces = rows.mapInArrow(run, kinds + ", ids array<int>" * with_ids)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences to one folder per length, as a curriculum by length reads them."""
    pieces.write.partitionBy("length").parquet(path)


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
