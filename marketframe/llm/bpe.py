"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, table, text_bytes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Characters that are encoded in one call; longer texts are cut before it.
CALL = 1 << 16

#: A space or line end after anything but white space. No match of the splitting
#: pattern crosses such a place, and none looks behind it.
SAFE = re.compile(r"(?<=\S)[ \n]")

#: White space as the pattern means it, in runs that are too long for its engine.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % CALL)


@functools.lru_cache(maxsize=2)
def encoding(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def safe_parts(text: str, call: int = CALL) -> Iterator[str]:
    """Cut a long text at safe places, each part ``call`` characters or a little more."""
    start = 0
    while len(text) - start > call and (cut := SAFE.search(text, start + call)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, ranks: str = RANKS, call: int = CALL) -> np.ndarray:
    """Ids of a text. Of a long run of white space all but the last character is one match of
    the pattern, and at the text's end the last one too; such a match is encoded directly."""
    codec = encoding(ranks)
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [codec.encode_ordinary(part) for part in safe_parts(text[at : run.start()], call)]
        out.append(codec._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    out += [codec.encode_ordinary(part) for part in safe_parts(text[at:], call)]
    return np.concatenate([np.asarray(ids, np.int32) for ids in out])


def _ids_column(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row.

    A null or empty text has no ids; repeated rows and null keys stay as they are;
    other columns of the input are not read. Texts of any length are whole: long
    ones are only cut where the splitting pattern cuts them anyway.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            rows = [encode_text(t.decode("utf-8", "replace"), ranks) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _ids_column(rows)], [key, "ids"])

    rows = df.select(F.col(key), text_bytes(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks: str = RANKS, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``decoded``: the raw bytes of the ids, which need not be
    whole characters. Null ids give null bytes."""

    def run(batches):
        codec = encoding(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [None if x is None else codec.decode_bytes(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [key, "ids", "decoded"])

    rows = df.select(key, "ids")
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
