"""Encoding, packing and media columns against their libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from helpers import awkward_texts, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketframe.llm import bpe, matroska, packing


def test_encoding_equals_the_library_and_decodes_back(spark):
    codec = bpe.encoding(bpe.RANKS)
    got = bpe.decode(bpe.encode(documents(spark))).collect()
    want = sorted([(k, codec.encode_ordinary(t or ""), (t or "").encode()) for k, t in awkward_texts()], key=repr)
    assert sorted([(r.doc_id, list(r.ids), bytes(r.decoded)) for r in got], key=repr) == want
    assert bpe.encode(documents(spark).limit(0)).count() == 0


def test_cutting_long_texts_changes_no_ids():
    codec, r = bpe.encoding(bpe.RANKS), random.Random(3)
    signs = "ab Z9'.,!  \n\n\t\r\x0b\x1c　 é中ا😀"
    for _ in range(400):
        text = "".join(r.choice(signs) for _ in range(200))
        assert list(bpe.encode_text(text, call=r.randint(1, 30))) == codec.encode_ordinary(text)
    text = "word " * 50_000 + "x" * 200_000
    assert list(bpe.encode_text(text)) == codec.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\n", "\u3000"])
def test_long_runs_of_white_space(space):
    codec = bpe.encoding(bpe.RANKS)
    n = bpe.CALL + 7
    for text in (space * n, "a" + space * n + "b", space * n + " b", "a" + space * n, f"x{space * n}\t'{space * n}7 {space * 5}!"):
        assert list(bpe.encode_text(text)) == codec.encode_ordinary(text)


def test_white_space_beyond_what_the_library_takes():
    codec = bpe.encoding(bpe.RANKS)
    for text in (" " * 2_000_000 + "end", "a" + "\n" * 2_000_000):
        assert codec.decode(bpe.encode_text(text).tolist()) == text


def test_raw_bytes_need_not_be_characters(spark):
    codec = bpe.encoding(bpe.RANKS)
    ids = codec.encode_ordinary("é😀")
    row = spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(row).collect()}
    assert bytes(got[1]) == codec.decode_bytes(ids[:1]) and got[2] is None


def test_word_ids_equal_the_tokenizer():
    own, r = packing.Ids(packing.TOKENIZER), random.Random(1)
    plain = Tokenizer.from_file(packing.TOKENIZER)
    signs = "ab Z9'.,!  \n\t\r\x0b\x0c\x1c　 ​́éßñ×÷中ا١²😀%&|"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["it's we'll I'd'S", "", "<|endoftext|> a<|endoftext|>"]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    packing_generation, packing.GENERATION = packing.GENERATION, 50
    try:
        assert [own.of(texts[i : i + 100])[0] for i in range(0, len(texts), 100)] == want[::100]
        assert own.of(texts) == want
    finally:
        packing.GENERATION = packing_generation


@pytest.mark.parametrize("n,want", [(1, [1]), (2048, [2048]), (2047, [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]), (4101, [2048, 2048, 4, 1])])
def test_binary_lengths(n, want):
    assert packing.binary_lengths(n) == want


def test_packing_holds_each_id_once(spark, tmp_path):
    plain = Tokenizer.from_file(packing.TOKENIZER)
    out = packing.pack(documents(spark), with_ids=True)
    rows = out.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_key = {}
    for r in rows:
        assert r.offset == 0 and r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        by_key.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for k, t in awkward_texts():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [packing.END]
        if k in (None, 19):
            continue
        pieces = sorted(by_key[k, len(ids)], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert [x for r in pieces for x in r.ids] == ids
    assert len([r for r in rows if r.doc_id == 19]) == 2 * len({r.start for r in rows if r.doc_id == 19})
    packing.write_buckets(out, str(tmp_path / "buckets"))
    again = spark.read.parquet(str(tmp_path / "buckets"))
    assert again.groupBy("length").count().count() == len({r.length for r in rows}) and again.count() == len(rows)
    assert packing.pack(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing_of_each_kind(lacing):
    frames = [bytes([i]) * (300 if lacing == matroska.FIXED else n) for i, n in enumerate((300, 0, 255, 17, 1000, 254, 70_000))]
    content = matroska.block(1, -5, frames, lacing)
    media = matroska.Media(clusters=[0])
    matroska._block(content, 0, len(content), 100, 10**6, {1: 24}, media, 0, None)
    assert [content[p[2] : p[2] + p[3]] for p in media.packets] == frames
    assert [p[1] for p in media.packets] == [95 * 10**6 + 24 * k for k in range(len(frames))]


def test_unknown_sizes_fillers_and_block_groups():
    m = matroska
    inside = m.number(m.TIMESTAMP, 7) + m.element(m.VOID, b"junk") + m.element(
        m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, 1, [b"abc"], m.NO_LACING)) + m.number(m.BLOCK_DURATION, 3)
    )
    again = m.number(m.TIMESTAMP, 9) + m.element(m.SIMPLE_BLOCK, m.block(2, 0, [b"de", b"f"], m.XIPH))
    unknown = b"\x01" + b"\xff" * 7
    data = m._EBML_HEAD + m.name(m.SEGMENT) + unknown + m._SEGMENT_HEAD + m.element(m.CRC32, b"1234")
    data += m.name(m.CLUSTER) + unknown + inside + m.name(m.CLUSTER) + unknown + again
    media = m.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4], p[5]) for p in media.packets] == [
        (1, 8_000_000, b"abc", True, 0), (2, 9_000_000, b"de", True, 1), (2, 9_000_000, b"f", True, 1),
    ]
    assert media.tracks[0][2:] == ("A_PCM/INT/LIT", 8000.0, 1, 8)


def test_damaged_files_are_reported():
    data = matroska.mux(b"x" * 1920)
    for cut in (1, 10, len(data) // 2, len(data) - 1):
        with pytest.raises(matroska.Damaged):
            matroska.parse(data[:cut])
    with pytest.raises(matroska.Damaged):
        matroska.parse(b"RIFF....")


def test_media_columns_round_trip(spark):
    media = matroska.media_of_texts(documents(spark))
    rows = {(r.doc_id, r.n_bytes): r for r in matroska.read_samples(media).collect()}
    for k, t in awkward_texts():
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[k, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert rows[1, len(awkward_texts()[0][1].encode())].media_sha256 == rows[2, len(awkward_texts()[1][1].encode())].media_sha256
    packets = matroska.packet_table(media)
    sizes = {r.doc_id: (r.n, r.cued) for r in packets.groupBy("doc_id").agg(F.sum("size").alias("n"), F.min("cue").alias("cued")).collect()}
    assert sizes[14][0] == rows[14, len(awkward_texts()[13][1].encode())].payload_bytes and sizes[14][1]
    assert matroska.packet_table(media.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert matroska.packet_table(none).count() == 0
