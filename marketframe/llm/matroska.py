"""Matroska media columns: writing sound tracks, and parsing packets, lacing and cues.

A file is a tree of EBML elements: a number of variable length that names the element,
one that gives its size, and the content. Sound is kept in clusters of blocks; a block
may lace several frames together.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, table, text_bytes

# Element names of the format.
EBML, SEGMENT, VOID, CRC32 = 0x1A45DFA3, 0x18538067, 0xEC, 0xBF
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: A frame is 24 ms of 8-bit samples at 8 kHz. Blocks lace up to 8 frames, clusters have up to 32 blocks.
FRAME, RATE, LACED, BLOCKS = 192, 8000, 8, 32


def name(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def size(n: int) -> bytes:
    """The shortest form of a size; all ones would mean unknown."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, content: bytes) -> bytes:
    return name(kind) + size(len(content)) + content


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    """A difference of sizes in EBML lacing: shifted so that it is not negative."""
    length = 1
    while not -(1 << 7 * length - 1) < n < (1 << 7 * length - 1):
        length += 1
    return (n + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def block(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    """Content of a block: track, time in its cluster, flags, lace sizes and frames."""
    if len(frames) == 1:
        lacing = NO_LACING
    head = size(track) + struct.pack(">hB", at, 0x80 | lacing << 1)
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def _head() -> tuple[bytes, bytes]:
    ebml = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    sound = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    track += number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, sound)
    info = number(TIMESTAMP_SCALE, 10**6) + element(MUXING_APP, b"marketframe") + element(WRITING_APP, b"marketframe")
    return ebml, element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, track))


_EBML_HEAD, _SEGMENT_HEAD = _head()


def mux(samples: bytes) -> bytes:
    """A file with one track of 8-bit samples; equal samples give equal files.

    Clusters take fixed, EBML and Xiph lacing in turn. A cue points at each cluster.
    """
    parts, cues, position = [_SEGMENT_HEAD], [], len(_SEGMENT_HEAD)
    step, ms = FRAME * LACED, FRAME * 1000 // RATE
    for cluster, base in enumerate(range(0, len(samples), step * BLOCKS)):
        time = base // FRAME * ms
        content = [number(TIMESTAMP, time)]
        for k, at in enumerate(range(base, min(base + step * BLOCKS, len(samples)), step)):
            some = samples[at : at + step]
            frames = [some[i : i + FRAME] for i in range(0, len(some), FRAME)]
            lacing = (FIXED, EBML_LACING, XIPH)[cluster % 3]
            if lacing == FIXED and len(some) % FRAME:
                lacing = XIPH
            content.append(element(SIMPLE_BLOCK, block(1, k * LACED * ms, frames, lacing)))
        whole = element(CLUSTER, b"".join(content))
        where = element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, position))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + where))
        parts.append(whole)
        position += len(whole)
    parts.append(element(CUES, b"".join(cues)))
    return _EBML_HEAD + element(SEGMENT, b"".join(parts))


class Damaged(ValueError):
    """The bytes are not a whole file of this format."""


def read_number(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """A number of variable length and its end; -1 for the reserved form, all ones."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Damaged(f"cut number at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_mark:
        return value, at + length
    value ^= 1 << 7 * length
    return (-1 if value == (1 << 7 * length) - 1 else value), at + length


def children(data: bytes, at: int, end: int):
    """``kind, start, end`` of the elements in a range; fillers and checksums are left
    out. An element of unknown size ends at the next of the top level, or with its parent."""
    while at < end:
        kind, start = read_number(data, at, keep_mark=True)
        length, start = read_number(data, start)
        if length < 0:
            stop = end
            if kind not in (SEGMENT, CLUSTER):
                raise Damaged(f"unknown size at byte {at}")
            if kind == CLUSTER:
                stop = next((b for k, b, _ in _raw(data, start, end) if k in TOP_LEVEL), end)
        else:
            stop = start + length
        if stop > end:
            raise Damaged(f"element at byte {at} is cut")
        if kind not in (VOID, CRC32):
            yield kind, start, stop
        at = stop


def _raw(data: bytes, at: int, end: int):
    """Elements one after the other, with where their names begin."""
    while at < end:
        kind, start = read_number(data, at, keep_mark=True)
        yield kind, at, start
        if kind in TOP_LEVEL:
            return
        length, start = read_number(data, start)
        at = start + length


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Damaged(f"block without frames at byte {at}")
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        each, rest = divmod(end - at, count)
        if rest:
            raise Damaged(f"uneven lace at byte {at}")
        return [each] * count, at
    sizes = []
    for k in range(count - 1):
        if lacing == XIPH:
            n = 0
            while True:
                if at >= end:
                    raise Damaged(f"cut lace at byte {at}")
                part, at = data[at], at + 1
                n += part
                if part < 255:
                    break
        else:
            start = at
            n, at = read_number(data, at)
            if k:
                n += sizes[-1] + 1 - (1 << 7 * (at - start) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace beyond its block at byte {at}")
    return sizes, at


@dataclass
class Media:
    """What a file holds. ``packets`` has ``track, timestamp (ns), start, size, keyframe,
    cluster``; ``cues`` has ``timestamp (ns), track, cluster``; both give byte offsets."""

    tracks: list[tuple[int, int, str, float, int, int]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def parse(data: bytes) -> Media:
    media, scale, durations = Media(), 10**6, {}
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Damaged("no EBML head")
    for kind, at, end in top:
        if kind != SEGMENT:
            continue
        base = at
        for kind, at, end in children(data, base, end):
            if kind == INFO:
                scale = next((unsigned(data, a, b) for k, a, b in children(data, at, end) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for _, a, b in children(data, at, end):
                    _track(data, a, b, media, durations)
            elif kind == CLUSTER:
                media.clusters.append(at)
                _cluster(data, at, end, scale, durations, media)
            elif kind == CUES:
                for _, a, b in children(data, at, end):
                    _cue(data, a, b, base, scale, media)
    return media


def _track(data: bytes, at: int, end: int, media: Media, durations: dict[int, int]) -> None:
    found = {k: (a, b) for k, a, b in children(data, at, end)}
    get = lambda kind, default=0: unsigned(data, *found[kind]) if kind in found else default
    sound = {k: (a, b) for k, a, b in children(data, *found[AUDIO])} if AUDIO in found else {}
    rate = 8000.0
    if SAMPLING_FREQUENCY in sound:
        a, b = sound[SAMPLING_FREQUENCY]
        rate = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
    depth = unsigned(data, *sound[BIT_DEPTH]) if BIT_DEPTH in sound else 0
    channels = unsigned(data, *sound[CHANNELS]) if CHANNELS in sound else 1
    codec = data[slice(*found[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in found else ""
    media.tracks.append((get(TRACK_NUMBER), get(TRACK_TYPE), codec, rate, channels, depth))
    durations[get(TRACK_NUMBER)] = get(DEFAULT_DURATION)


def _cluster(data: bytes, at: int, end: int, scale: int, durations: dict[int, int], media: Media) -> None:
    time, cluster = 0, len(media.clusters) - 1
    for kind, a, b in children(data, at, end):
        if kind == TIMESTAMP:
            time = unsigned(data, a, b)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, time, scale, durations, media, cluster, None)
        elif kind == BLOCK_GROUP:
            inner = {k: (x, y) for k, x, y in children(data, a, b)}
            if BLOCK in inner:
                _block(data, *inner[BLOCK], time, scale, durations, media, cluster, REFERENCE not in inner)


def _block(data, at, end, time, scale, durations, media, cluster, keyframe) -> None:
    track, at = read_number(data, at)
    if at + 3 > end:
        raise Damaged(f"cut block at byte {at}")
    offset, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    first, step = (time + offset) * scale, durations.get(track, 0)
    key = bool(flags & 0x80) if keyframe is None else keyframe
    starts = itertools.accumulate(sizes, initial=at)
    media.packets += [(track, first + k * step, start, n, key, cluster) for k, (start, n) in enumerate(zip(starts, sizes))]


def _cue(data: bytes, at: int, end: int, base: int, scale: int, media: Media) -> None:
    time = 0
    for kind, a, b in children(data, at, end):
        if kind == CUE_TIME:
            time = unsigned(data, a, b)
        elif kind == CUE_TRACK_POSITIONS:
            found = {k: unsigned(data, x, y) for k, x, y in children(data, a, b)}
            media.cues.append((time * scale, found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER_POSITION, 0)))


def samples_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's frames in order of time."""
    mine = sorted((p for p in media.packets if p[0] == track), key=lambda p: p[1])
    return b"".join([data[p[2] : p[2] + p[3]] for p in mine])


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def media_of_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: each text, padded with spaces to whole frames, as a sound file.

    Null counts as empty, which is one frame of spaces. Every row gets a file, repeated
    rows and null keys too; other columns are not read.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            texts = part.column("text").to_pylist()
            columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64())]
            columns.append(pa.array([mux(padded(t)) for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "media"])

    rows = df.select(F.col(key), text_bytes(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


PACKET = "track int, timestamp bigint, start bigint, size bigint, keyframe boolean, cluster int"


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of a media column: ``key``, packet columns and ``cue``, whether
    a cue points at its cluster. Null media have no packets; damaged media raise ``Damaged``."""

    def run(batches):
        for part in chunks(batches, "media", 1 << 20):
            rows, packets, cued = [], [], []
            for row, data in enumerate(part.column("media").to_pylist()):
                found = parse(data) if data is not None else Media()
                # A cue gives where a cluster's name begins, a few bytes before its content.
                marks = {next(children(data, c, len(data)))[1] for _, _, c in found.cues}
                cued += [found.clusters[p[5]] in marks for p in found.packets]
                rows += [row] * len(found.packets)
                packets += found.packets
            columns = list(zip(*packets)) or [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
            arrays = [part.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(cued, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "track", "timestamp", "start", "size", "keyframe", "cluster", "cue"]
    rows = df.select(F.col(key), F.col(media).alias("media"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKET}, cue boolean")


def describe(data: bytes) -> tuple[bytes, str]:
    """The samples of track 1 and a line about them: codec, packets, clusters, cues that
    hit a cluster, duration, mean and root mean square of the samples."""
    media = parse(data)
    samples = samples_of(data, media)
    codec, rate, depth = next(((t[2], t[3], t[5]) for t in media.tracks if t[0] == 1), ("", 0.0, 0))
    hits = sum(next(children(data, c, len(data)))[1] in media.clusters for _, _, c in media.cues)
    values = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    mean, rms = (values.mean(), np.sqrt((values * values).mean())) if len(values) else (0.0, 0.0)
    seconds = len(samples) / rate if rate else 0.0
    return samples, (
        f"codec={codec};rate={rate:.0f};depth={depth};packets={len(media.packets)};clusters={len(media.clusters)};"
        f"cues={hits};seconds={seconds:.3f};mean={mean:.4f};rms={rms:.4f}"
    )


def read_samples(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of a media column: what its samples are once parsed and read back.

    Takes ``key, n_bytes, media``; gives ``key, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature``.
    """

    def run(batches):
        for part in chunks(batches, "media"):
            out = []
            for data in part.column("media").to_pylist():
                samples, feature = describe(data)
                out.append((
                    len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
                    len(data), hashlib.sha256(data).hexdigest(), feature,
                ))
            columns = [part.column(0), part.column(1)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns += [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(key, "n_bytes", "media").mapInArrow(
        run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, {kinds}"
    )


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_samples(media_of_texts(table(spark, sf_dir, "documents")))
