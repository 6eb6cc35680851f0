"""Removal of repeated and nearly repeated lines across documents.

A line's normalised form is its words, runs of letters and digits (and of all bytes
beyond ASCII), with A-Z lowered; in scripts without spaces each character is a word.
Equal forms are one node. Nodes meet by the blocks of a SimHash of their words
(Manku and others 2007), and link if few word edits turn one into the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import discard, materialise

from .batches import chunks, data, table, text_bytes
from .linking import components, marked
from .words import _LOWER, hash_spans, mix, spans

#: Edits in percent of the longer line's words up to which lines link. Shorter lines than
#: make one edit link only if they are equal.
EDITS = 5
LEAST_WORDS = 100 // EDITS

#: Blocks of a SimHash and their bits. Two lines that differ in fewer bits than there are
#: blocks have one in common, and of others the more the fewer they differ in.
BLOCKS, BLOCK_BITS = 7, 18

#: Lines are compared if at most so many bits of their blocks differ: unlike ones differ in half.
BITS = 22

#: What is compared of two lines before their words are: parities of words, and the SimHash.
BITMAPS = ("odd", "sim0", "sim1")

#: Nodes of a block that are compared in one go; more are dealt, each two parts once.
PART = 2048

#: Words of the lines that one part of a neighbourhood has on average.
WORDS = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters of scripts without spaces: Thai, Lao, Tibetan,
    Myanmar, Khmer, kana and Han."""
    at = np.flatnonzero(buf[: max(len(buf) - 2, 0)] >= 0xE0)
    lead, next_ = buf[at], buf[at + 1]
    between = lambda b, low, high: (lead == b) & (next_ >= low) & (next_ <= high)
    found = between(0xE0, 0xB8, 0xBF) | between(0xE1, 0x80, 0x81) | (between(0xE1, 0x82, 0x82) & (buf[at + 2] < 0xA0))
    found |= between(0xE1, 0x9E, 0x9F) | between(0xE2, 0xBA, 0xBF) | ((lead >= 0xE3) & (lead <= 0xE9))
    found |= between(0xEF, 0xA4, 0xAB) | between(0xEF, 0xBD, 0xBE) | between(0xF0, 0xA0, 0xBF)
    at = at[found]
    return at, np.minimum(at + 3 + (buf[at] >= 0xF0), len(buf))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; each character of a script without spaces is one."""
    inside = _WORD[buf]
    start, end = spans(inside, off)
    at, after = unspaced(buf)
    if len(at):
        after = after[after < len(buf)]
        start = np.unique(np.concatenate([start, at, after[inside[after]]]))
        end = np.minimum(end[np.searchsorted(end, start, "right")], np.append(start[1:], len(buf)))
    return start, end


def split_lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line of each row: the row, its number there and where its words start
    (one more than lines); and the hashes of all words."""
    breaks = np.flatnonzero(buf == 0x0A)
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    at, end = word_spans(buf, off)
    first = np.append(np.searchsorted(at, start), len(at))
    return row, number, first, hash_spans(_LOWER[buf], at, end)


def line_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """63 bits of each line's normalised form."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    total = np.append(np.uint64(0), np.cumsum(mix(words + mix(place.astype(np.uint64))), dtype=np.uint64))
    return mix(total[first[1:]] - total[first[:-1]]) >> np.uint64(1)


#: A byte's eight bits in the eight bytes of a number: adding these counts bits, up to 255 times.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def simhashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits for each line: bit by bit what most of its words' hashes have."""
    size = np.diff(first)
    packed = np.zeros((len(size), 16), np.uint8)
    full = np.flatnonzero(size)
    if not len(full):
        return packed.view(np.int64)
    parts = -(-size[full] // 255)
    lead = np.cumsum(parts) - parts
    start = np.repeat(first[:-1][full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(lead, parts))
    for half in (0, 1):
        h = mix(words + np.uint64(half)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[h[:, k]], start).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes, lead, axis=0, dtype=np.int64) if len(start) > len(full) else lanes.astype(np.int64)
            packed[full, 8 * half + k] = np.packbits(2 * votes > size[full, None], axis=1)[:, 0]
    return packed.view(np.int64)


def parities(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each line: which of 64 classes of words it has an odd number of.

    An insertion or deletion changes one bit at most and a replacement two, so lines
    within ``e`` edits whose sizes differ by ``d`` differ in at most ``2 * e - d`` bits.
    """
    out, full = np.zeros(len(first) - 1, np.uint64), np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(words + np.uint64(2)) & np.uint64(63)), first[:-1][full])
    return out.view(np.int64)


def hashed_lines(rows: DataFrame) -> DataFrame:
    """``doc_id, line, id, size, odd, sim0, sim1`` of every line with a word; short ones have zeros."""

    def run(batches):
        for part in chunks(batches, "text", 2 << 20):
            row, number, first, words = split_lines(*data(part.column("text")))
            size = np.diff(first)
            keep = np.flatnonzero(size)
            sims = np.column_stack([parities(words, first), simhashes(words, first)])[keep]
            sims[size[keep] < LEAST_WORDS] = 0
            columns = [part.column(0).take(pa.array(row[keep])), pa.array(number[keep].astype(np.int32))]
            columns += [pa.array(line_hashes(words, first)[keep].view(np.int64)), pa.array(size[keep].astype(np.int32))]
            columns += [pa.array(np.ascontiguousarray(sims[:, k])) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "line", "id", "size", *BITMAPS]
    return rows.mapInArrow(run, "doc_id bigint, line int, id bigint, size int, odd bigint, sim0 bigint, sim1 bigint")


def blocks_of(sim0: Column, sim1: Column) -> Column:
    """The blocks, each with its number: three of either half, one of what both have left."""
    mask = (1 << BLOCK_BITS) - 1
    cut = lambda s, k: F.shiftrightunsigned(s, BLOCK_BITS * k).bitwiseAND(F.lit(mask))
    own = [cut(s, k) for s in (sim0, sim1) for k in range(3)]
    half = BLOCK_BITS // 2
    ends = [F.shiftrightunsigned(s, 3 * BLOCK_BITS).bitwiseAND(F.lit((1 << half) - 1)) for s in (sim0, sim1)]
    return F.array(*[(b * BLOCKS + k).cast("int") for k, b in enumerate([*own, F.shiftleft(ends[0], half) + ends[1]])])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of one key and part, of batches sorted by these."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
        # The last run may go on in the next batch.
        last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
        if last or (waiting and (waiting[-1].column("key")[-1].as_py(), waiting[-1].column("part")[-1].as_py()) != (key[0], part[0])):
            yield pa.concat_tables([*waiting, rows.slice(0, last)])
            waiting = []
        waiting.append(rows.slice(last))
    if waiting:
        yield pa.concat_tables(waiting)


def _ends(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of one key and part start and end."""
    key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(key)])
    return starts, np.append(starts[1:], len(key)) if len(key) else starts


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the ``n`` rows as the given ones do: from each to its group's first."""
    name = np.arange(n)
    while True:
        low, after = np.minimum(name[x], name[y]), name.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if np.array_equal(after, name):
            break
        name = after
    away = np.flatnonzero(name != np.arange(n))
    return name[away], away


def compared(batches: Iterator[pa.RecordBatch], forest: bool = False) -> Iterator[pa.RecordBatch]:
    """``a, b`` of rows ``key, part, side, size, id, odd, sim0, sim1`` sorted by key, part and size:
    pairs of one key and part that fit and are of different components, if there is such a
    column. A part of two sides compares each row of one with each of the other. With
    ``forest``, no more pairs than connect the same rows."""
    for rows in runs(batches):
        side, size, ids, odd, *sims = (rows.column(c).to_numpy() for c in ("side", "size", "id", *BITMAPS))
        component = rows.column("component").to_numpy() if "component" in rows.column_names else ids
        starts, ends = _ends(rows)
        left, found = np.arange(len(ids)), []
        end = np.repeat(ends, ends - starts)
        gap = 0
        while len(left):
            gap += 1
            left = left[left + gap < end[left]]
            right = left + gap
            most, apart = size[right] * EDITS // 100, size[right] - size[left]
            # Sizes ascend: what lies further on is too long as well.
            near = apart <= most
            left, right, most, apart = left[near], right[near], most[near], apart[near]
            good = np.bitwise_count((odd[left] ^ odd[right]).view(np.uint64)) <= 2 * most - apart
            x, y = left[good], right[good]
            good = (component[x] != component[y]) & ((side[x] < 0) | (side[x] != side[y]))
            differ = [np.bitwise_count((s[x] ^ s[y]).view(np.uint64) << np.uint64(1)) for s in sims]
            good &= differ[0] + differ[1] <= BITS
            found.append((x[good], y[good]))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        if forest:
            x, y = _forest(len(ids), x, y)
        both = np.stack([ids[x], ids[y]])
        yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0))], ["a", "b"])


def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``key, part, side`` and columns of ``rows``, each key's dealt over its ``parts`` (null: one), of
    which every two meet once; inside a part of its own all rows meet, by a side below 0."""
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda h: F.least(own, h) * F.col("parts") + F.greatest(own, h))
    part = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(met)).alias("part")
    rows = rows.select("key", part, own.alias("own"), "parts", *columns)
    inner = F.col("parts").isNull() | (F.col("part") % (F.col("parts") + 1) == 0)
    return rows.select("key", "part", F.when(inner, -1).otherwise(F.col("own")).alias("side"), *columns)


def block_pairs(nodes: DataFrame, forest: bool = False) -> DataFrame:
    """``a, b``: nodes of different components that share a block and fit; parities and components
    may be absent. With ``forest``, of each block only pairs that connect the same nodes.

    There are at most ``BLOCKS * 2 ** BLOCK_BITS`` different keys, so the list of those with
    many nodes may be broadcast; their nodes are dealt over parts, and every two parts meet once.
    """
    if "odd" not in nodes.columns:
        nodes = nodes.withColumn("odd", F.lit(0).cast("bigint"))
    columns = [c for c in ("id", "component", "size", *BITMAPS) if c in nodes.columns]
    posts = nodes.select(F.explode(F.col("keys").cast("array<int>")).alias("key"), *columns)
    many = posts.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > PART)
    rows = posts.join(F.broadcast(many.select("key", F.ceil(F.col("_n") / PART).cast("int").alias("parts"))), "key", "left")
    sorted_rows = dealt(rows, columns).repartition("key", "part").sortWithinPartitions("key", "part", "size")
    pairs = sorted_rows.mapInArrow(lambda batches: compared(batches, forest), "a bigint, b bigint")
    return materialise(pairs if forest else pairs.distinct())


def words_of_lines(rows: DataFrame) -> DataFrame:
    """``id, words``: the word hashes of the lines that column ``wanted`` numbers."""

    def run(batches):
        for part in chunks(batches, "text", 2 << 20):
            row, number, first, words = split_lines(*data(part.column("text")))
            ids = line_hashes(words, first).view(np.int64)
            start = np.searchsorted(row, np.arange(part.num_rows))
            lines = [start[i] + x for i, want in enumerate(part.column("wanted").to_pylist()) for x in want]
            values = [words[first[x] : first[x + 1]].tobytes() for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lines]), pa.array(values, pa.binary())], ["id", "words"])

    return rows.mapInArrow(run, "id bigint, words binary")


def _sums(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums, up to each place, of the values times a power for their place."""
    return np.append(np.uint64(0), np.cumsum(mix(x) * power[: len(x)], dtype=np.uint64))


def within_edits(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether ``most`` insertions, deletions or replacements turn x into y.

    For each number of edits and all diagonals at once, how far along x they reach
    (Ukkonen); how far two stretches are equal is found by halving, with sums that say
    whether they are.
    """
    m, n = len(x), len(y)
    if abs(m - n) > most:
        return False
    # What both begin and end with takes no edit.
    k = min(m, n)
    other = np.flatnonzero(x[:k] != y[:k])
    if m == n and len(other) <= most:
        return True
    lead = int(other[0]) if len(other) else k
    other = np.flatnonzero(x[m - k + lead :][::-1] != y[n - k + lead :][::-1]) if lead < k else other
    tail = int(other[0]) if len(other) else k - lead
    x, y = x[lead : m - tail], y[lead : n - tail]
    m, n = len(x), len(y)
    if max(m, n) <= most:
        return True
    if most <= 1:
        return False
    # Each word that only one side has takes an edit.
    both, back = np.unique(np.append(x, y), return_inverse=True)
    more = np.bincount(back[:m], minlength=len(both)) - np.bincount(back[m:], minlength=len(both))
    if max(more[more > 0].sum(), -more[more < 0].sum()) > most:
        return False
    power = np.cumprod(np.append(np.uint64(1), np.full(max(m, n), 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
    sx, sy = _sums(x, power), _sums(y, power)
    d = np.arange(-most, most + 1)
    ahead, behind = power[np.minimum(np.maximum(d, 0), max(m, n))], power[np.minimum(np.maximum(-d, 0), max(m, n))]

    def slide(i: np.ndarray, on: np.ndarray) -> np.ndarray:
        """How far along x the diagonals ``on`` get from places i without an edit."""
        at = i[on]
        other, room = at + d[on], np.minimum(m - at, n - at - d[on])
        low = np.zeros(len(at), np.int64)
        step = 1 << int(max(room.max(initial=0), 1)).bit_length() - 1
        while step:
            want = low + step
            ok = want <= room
            end, far = np.where(ok, at + want, at), np.where(ok, other + want, other)
            ok &= (sx[end] - sx[at]) * ahead[on] == (sy[far] - sy[other]) * behind[on]
            low = np.where(ok, want, low)
            step >>= 1
        out = i.copy()
        out[on] = at + low
        return out

    none = -(1 << 40)
    reach = np.full(2 * most + 1, none)
    reach[most] = 0
    inside = (d >= -m) & (d <= n)
    for edits in range(most + 1):
        if edits:
            left, right = np.append(none, reach[:-1]), np.append(reach[1:] + 1, none)
            reach = np.minimum(np.maximum(np.maximum(left, right), reach + 1), np.minimum(m, n - d))
        on = np.flatnonzero((reach >= 0) & (reach + d >= 0) & inside)
        reach = slide(reach, on)
        if reach[most + n - m] == m:
            return True
    return False


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: links that connect rows ``key, part, side, id, size, odd, sim0, sim1, words`` of one key
    and part as all their links do. Rows that are connected already are not compared."""
    for rows in runs(batches):
        side, size, ids, odd, *sims = (rows.column(c).to_numpy() for c in ("side", "size", "id", *BITMAPS))
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("words")]
        found = []
        for start, end in zip(*(x.tolist() for x in _ends(rows))):
            name = np.arange(start, end)
            for i in range(start, end - 1):
                j = np.flatnonzero(name[i + 1 - start :] != name[i - start]) + i + 1
                j = j[(side[i] < 0) | (side[j] != side[i])]
                differ = alike(size[i], odd[i], [s[i] for s in sims], size[j], odd[j], [s[j] for s in sims])
                met = np.flatnonzero(differ <= BITS)
                for y in j[met[np.argsort(differ[met], kind="stable")]].tolist():
                    if name[y - start] != name[i - start] and within_edits(words[i], words[y], max(len(words[i]), len(words[y])) * EDITS // 100):
                        name[name == name[y - start]] = name[i - start]
                        found.append((ids[i], ids[y]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def alike(size, odd, sims, sizes, odds, others) -> np.ndarray:
    """The bits in which a node's SimHash differs from each of others'; more than there are,
    where they share no block or can't be within the edit limit by sizes and parities."""
    most, apart = np.maximum(sizes, size) * EDITS // 100, np.abs(sizes - size)
    one, two = ((s ^ x).view(np.uint64) for s, x in zip(others, sims))
    shared, low = np.zeros(len(sizes), bool), np.uint64((1 << BLOCK_BITS) - 1)
    for k in range(3):
        by = np.uint64(BLOCK_BITS * k)
        shared |= ((one >> by) & low == 0) | ((two >> by) & low == 0)
    shared |= ((one | two) >> np.uint64(3 * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS // 2) - 1) == 0
    shared &= (apart <= most) & (np.bitwise_count((odds ^ odd).view(np.uint64)) <= 2 * most - apart)
    differ = np.bitwise_count(one << np.uint64(1)).astype(np.int64) + np.bitwise_count(two << np.uint64(1))
    return np.where(shared, differ, 1 << 20)


def verified(near: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: links that connect the nodes ``near`` (``key, id, doc_id, line, size, odd, sim0, sim1``) of one key
    as all links of nodes that share a block do. Words are read from where lines first occur.

    A key of many nodes or words is dealt over parts, of which every two meet in one task.
    """
    wanted = materialise(near.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")))
    texts = marked(rows, wanted.select(F.col("doc_id").alias("id")), "doc_id").where("_maybe")
    # Merge joins at every size: these lists grow with the corpus, so none is broadcast.
    words = words_of_lines(texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted")).dropDuplicates(["id"])
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / WORDS)).cast("int")
    many = near.groupBy("key").agg(parts.alias("parts")).where("parts > 1")
    columns = ["id", "size", *BITMAPS, "words"]
    met = near.join(many.hint("merge"), "key", "left").join(words.hint("merge"), "id")
    out = materialise(dealt(met, columns).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(linked, "a bigint, b bigint"))
    discard(wanted)
    return out


def repeated_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, removed``: the numbers of the lines to remove, of documents that have any.

    Equal normalised lines of any number of words are one node. Nodes of at least
    ``LEAST_WORDS`` words meet in the blocks of their SimHash. Those that are alike in size
    and in most bits are neighbours; of a connected neighbourhood the words are sent
    once, and pairs of neighbours that nothing connects yet are held against the
    edit limit. So links and pairs handed on grow with the nodes, not with the pairs
    of a group. Of each connected group the first occurrence, by key and line number,
    stays.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), text_bytes(text).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull())
    lines = materialise(hashed_lines(rows))
    occurrence = F.struct("doc_id", "line")
    nodes = lines.groupBy("id").agg(
        F.min(occurrence).alias("first"), F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("size", *BITMAPS)]
    )
    nodes = materialise(nodes)

    blocks = blocks_of(F.col("sim0"), F.col("sim1")).alias("keys")
    long = nodes.where(F.col("size") >= LEAST_WORDS)
    pairs = block_pairs(long.select("id", "size", *BITMAPS, blocks), forest=True)
    lie = components(pairs)
    near = long.join(lie.withColumnRenamed("component", "key").hint("merge"), "id")
    near = materialise(near.select("key", "id", "first.*", "size", *BITMAPS))
    discard(pairs, lie)
    links = verified(near, rows)
    found = components(links)
    discard(near, links)
    grouped = nodes.select("id", "first", "times").join(found.hint("merge"), "id", "left")
    grouped = grouped.where("times > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "id"))
    grouped = materialise(grouped.select("id", "first", "component"))
    kept = grouped.groupBy("component").agg(F.min("first").alias("kept"))
    of_line = grouped.select("id", "component").join(kept.hint("merge"), "component").select("id", "kept")
    discard(nodes)
    gone = lines.select("id", "doc_id", "line").join(of_line.hint("merge"), "id").where(occurrence != F.col("kept"))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("removed")).withColumnRenamed("doc_id", key)


def remove_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their repeated lines removed, and the columns ``_lines`` (how
    many there were) and ``_removed``; input columns of these two names are replaced.

    Lines end at a line feed. All other columns, whatever their names, and all rows
    stay, also those that are left with no line (an empty text). A null text stays null,
    and a row with a null key is left alone. Rows with one key are one document: their
    lines of one number stay or go together. A long text is one line like another.
    ``documents`` may be empty.
    """
    gone = materialise(repeated_lines(documents, key, text).select(F.col(key).alias("id"), F.col("removed").alias("gone")))
    kept = [c for c in documents.columns if c not in ("_lines", "_removed")]
    # Input columns lie in a struct, so that no name of theirs meets one of these.
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rows = marked(rows, gone.select("id"), "id").withColumn("parts", F.split("text", "\n", -1))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts"))
    clean = rows.where("NOT _maybe").select("row", count.alias("lines"), F.lit(0).alias("removed"), "text")
    touched = rows.where("_maybe").join(gone.hint("merge"), "id", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest)
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    both = clean.union(touched.select("row", count.alias("lines"), removed.alias("removed"), left.alias("text")))
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept]
    return both.select(*columns, F.col("lines").alias("_lines"), F.col("removed").alias("_removed"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")
