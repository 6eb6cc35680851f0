"""Near copies and repeated lines against brute force."""

from __future__ import annotations

import itertools
import random
import re
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward_texts, documents, edited, prose
from pyspark.sql import functions as F

from marketframe.llm import fuzzy_lines, jaccard, linking, stars, words


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(n, links):
    name = list(range(n))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        name[b] = a
    return [root(i) for i in range(n)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_copies(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    group, lowest = groups(len(rows), links), {}
    for g, (k, _) in zip(group, rows):
        if k is not None:
            lowest[g] = min(k, lowest.get(g, k))
    return sorted(((k, len(s), lowest.get(g)) for (k, _), s, g in zip(rows, sets, group)), key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_components_equal_brute_force(spark):
    rows = awkward_texts()
    assert result(jaccard.near_copies(documents(spark, rows))) == brute_copies(rows)


def test_a_chain_of_copies_with_a_common_passage(spark):
    """Neighbours of a chain link, its ends do not; a passage stands in all other rows."""
    r, text, rows = random.Random(4), prose(9, 80).split(), []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[r.randrange(80)] = f"w{i}"
    passage = prose(10, 40)
    rows += [(100 + i, passage + " " + prose(400 + i, r.randint(5, 60))) for i in range(80)]
    rows += [(300 + i, edited(passage, i, i % 3)) for i in range(30)]
    assert result(jaccard.near_copies(documents(spark, rows))) == brute_copies(rows)


def test_no_documents(spark):
    assert jaccard.near_copies(documents(spark).limit(0)).count() == 0
    only = documents(spark, [(1, None), (2, "")])
    assert result(jaccard.near_copies(only)) == [(1, 0, 1), (2, 0, 2)]


def test_word_hashes_are_those_of_single_texts():
    texts = [t or "" for _, t in awkward_texts()]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, first = words.words(buf, off)
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        mine = h[first[i] : first[i + 1]]
        assert len(mine) == len(want) and len(set(mine.tolist())) == len(set(want))
        alone, _ = words.words(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))
        assert (alone == mine).all()


def test_connected_groups_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(200, 201), (300, 300)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(80)}, 200: 200, 201: 200, 300: 300}


def test_long_paths_of_links_take_no_more_rows_than_a_few_times_the_links(spark, monkeypatch):
    """All rounds together; rows that are settled are not written once more each round."""
    path, star = [(i, i + 1) for i in range(400)], [(1000, 1000 - i) for i in range(1, 200)]
    links, rows, plain = [*path, *star, (5000, 5000), (-7, 5001)], [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df: (out := plain(df), rows.append(out.count()))[0])
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(401)}, **{i: 801 for i in range(801, 1001)}, 5000: 5000, -7: -7, 5001: -7}
    assert sum(rows) <= 10 * len(links), rows


def test_bitmap_drops_rows_but_none_that_is_asked_for(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    ids = spark.range(0, 5000, 50)
    assert linking.among(rows, ids, "doc_id").count() == 100
    assert linking.marked(rows, ids, "doc_id").where("_maybe").count() < 200
    assert linking.among(rows, ids.limit(0), "doc_id").count() == 0


def normal(line):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(line))


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def simhash(line):
    raw = line.encode()
    _, _, first, h = fuzzy_lines.split_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [int(x) & (2**64 - 1) for x in fuzzy_lines.simhashes(h, first)[0]]


def blocks(sims):
    three = [s >> 18 * k & 0x3FFFF for s in sims for k in range(3)]
    return [*three, (sims[0] >> 54 & 511) << 9 | sims[1] >> 54 & 511]


def near(x, y):
    """Whether two lines (their words and SimHash) meet and are within the edit limit."""
    (w, s), (v, t) = x, y
    most = max(len(w), len(v)) * fuzzy_lines.EDITS // 100
    alike = abs(len(w) - len(v)) <= most and sum(bin((a ^ b) << 1 & 2**64 - 1).count("1") for a, b in zip(s, t)) <= fuzzy_lines.BITS
    return alike and any(a == b for a, b in zip(blocks(s), blocks(t))) and distance(w, v) <= most


def brute_lines(rows):
    """Kept texts: links by a common block and few edits, the first of each group stays."""
    lines = [(k, i, x) for k, t in rows if k is not None and t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if normal(x[2])]
    w = [(normal(x[2]), simhash(x[2])) for x in lines]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(lines)), 2)
        if w[i][0] == w[j][0] or (min(len(w[i][0]), len(w[j][0])) >= fuzzy_lines.LEAST_WORDS and near(w[i], w[j]))
    ]
    member = defaultdict(list)
    for g, (k, i, _) in zip(groups(len(lines), links), lines):
        member[g].append((k, i))
    gone = {x for m in member.values() for x in m if x != min(m)}
    return sorted(
        ((k, t if k is None or t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in rows),
        key=repr,
    )


def line_rows():
    base = [prose(20 + i, 12 + i) for i in range(12)]
    rows = [(1, "\n".join(base[:4])), (2, "\n".join(base[2:6])), (3, base[0].upper() + "!!"), (4, None), (5, ""), (6, "\n\n"),
            (7, "a b\na b\na b"), (8, "\n".join([base[7]] * 5 + ["short one", "short one"])), (9, base[8] + "\n"), (10, base[8] + "\n\n" + base[9]),
            (None, base[0]), (11, "Page 1 of 20 pages\nPage 7 of 93 pages"), (12, prose(77, 3000)), (13, edited(prose(77, 3000), 1, 20))]
    rows += [(20 + i, edited(base[11], i, 1 + i % 3) + "\n" + prose(600 + i, 9)) for i in range(25)]
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    out = fuzzy_lines.remove_lines(documents(spark, rows))
    assert result(out.select("doc_id", "text")) == brute_lines(rows)
    assert out.columns[:-2] == documents(spark, rows).columns
    got = {r.doc_id: (r._lines, r._removed) for r in out.collect()}
    assert got[8] == (7, 5) and got[7] == (3, 2) and got[4] == (0, 0) and got[11] == (2, 0) and got[13][1] == 1
    assert fuzzy_lines.remove_lines(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_edit_limit_equals_the_full_table(seed):
    r = random.Random(seed)
    x = [r.randrange(4) for _ in range(r.randrange(12 + 5 * seed))]
    y = [r.randrange(4) for _ in range(r.randrange(12))] if seed % 2 else [v if r.random() < 0.9 else 9 for v in x if r.random() < 0.95]
    for most in range(8):
        assert fuzzy_lines.within_edits(np.array(x, np.uint64), np.array(y, np.uint64), most) == (distance(x, y) <= most)


def test_simhash_counts_bits_of_long_lines():
    raw = ("aa bb cc " * 300 + "dd").encode()
    _, _, first, h = fuzzy_lines.split_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    bits = np.concatenate([np.unpackbits(words.mix(h + np.uint64(k)).view(np.uint8).reshape(-1, 8), axis=1) for k in (0, 1)], axis=1)
    want = np.packbits(2 * bits.sum(0, dtype=int) > len(h)).view(np.int64)
    assert (fuzzy_lines.simhashes(h, first)[0] == want).all()


def test_lines_that_differ_in_fewer_bits_than_blocks_share_one(spark):
    r, rows = random.Random(5), []
    for i in range(50):
        sims = [r.getrandbits(64) for _ in range(2)]
        other = list(sims)
        for _ in range(fuzzy_lines.BLOCKS - 1):
            other[r.randrange(2)] ^= 1 << r.randrange(63)
        rows += [(i, *[x - 2**64 if x >= 2**63 else x for x in s]) for s in (sims, other)]
    keys = defaultdict(list)
    df = spark.createDataFrame(rows, "id int, sim0 bigint, sim1 bigint")
    for x in df.select("id", "sim0", "sim1", fuzzy_lines.blocks_of(F.col("sim0"), F.col("sim1")).alias("keys")).collect():
        sims = [v % 2**64 for v in (x.sim0, x.sim1)]
        assert x["keys"] == [b * fuzzy_lines.BLOCKS + k for k, b in enumerate(blocks(sims))]
        keys[x.id].append(set(x["keys"]))
    assert all(a & b for a, b in keys.values())


def test_every_pair_of_a_common_block_meets_once(spark, monkeypatch):
    """A block of 300 nodes, dealt over parts of 40; some are of one component."""
    monkeypatch.setattr(fuzzy_lines, "PART", 40)
    rows = [(i, i - i % 3 if i < 90 else i, 30 + i % 3, 5 ^ (1 << i % 20), i % 7, [7 if i < 300 else 7 * i]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "id bigint, component bigint, size int, sim0 bigint, sim1 bigint, keys array<bigint>")
    got = sorted((r.a, r.b) for r in fuzzy_lines.block_pairs(nodes).collect())
    assert got == [(a[0], b[0]) for a, b in itertools.combinations(rows[:300], 2) if a[1] != b[1] and abs(a[2] - b[2]) <= 1]


def test_products_of_many_sets_need_bounded_memory():
    """The tables between 700 and 600 sets are many times larger than what is held of them at once."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(60) < 0.93], rng.integers(1, 1 << 62, 40 * (i % 2)).astype(np.uint64))) for i in range(1300)]
    tracemalloc.start()
    got = stars.similar_sets(75, 100)(sets[:700], sets[700:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, peak
    some = [(i, j) for i in range(0, 700, 23) for j in range(0, 600, 19)]
    assert [got[i, j] for i, j in some] == [jaccard.similar(sets[i], sets[700 + j]) for i, j in some] and 0 < got.sum() < got.size
    assert stars.similar_sets(75, 100)(sets[:1], []).shape == (1, 0)


def alike_in_passing(seed: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of three families: edited copies of one, sets with a few values of a common
    stock and many of their own, and sets of one or two values; and their components."""
    rng = np.random.default_rng(seed)
    stock = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    own = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(stock)[: 60 - k % 20], own(k % 14))) for k in range(150)]
    sets += [np.unique(np.append(rng.permutation(stock)[:12], own(24))) for k in range(150)]
    sets += [np.unique(stock[[k % 7, k % 5]]) for k in range(30)]
    return sets, rng.choice([0, 0, *range(1, 40)], len(sets))


@pytest.mark.parametrize("num", [75, 80])
def test_links_between_components_are_those_of_all_pairs(num):
    sets, of = alike_in_passing()
    order = np.random.default_rng(1).permutation(len(sets))
    sets, of = [sets[i] for i in order], of[order]
    common = lambda a, b: len(np.intersect1d(a, b))
    for x, y in ((range(len(sets)), range(len(sets))), (range(130), range(130, len(sets)))):
        got = {(of[x[i]], of[y[j]]) for a, b in stars.linked([sets[i] for i in x], of[x], [sets[j] for j in y], of[y], num, 100) for i, j in zip(a, b)}
        link = lambda a, b: 100 * common(a, b) >= num * (len(a) + len(b) - common(a, b))
        want = {(of[i], of[j]) for i in x for j in y if of[i] != of[j] and link(sets[i], sets[j])}
        assert got == want and want
    empty = np.empty(0, np.int64)
    assert not [1 for a, _ in stars.linked(sets[:1], of[:1], [], empty, num, 100) if len(a)]


def test_links_inside_a_neighbourhood_dealt_over_parts(spark, monkeypatch):
    """One neighbourhood of some 40 parts, of which every two meet, gives the groups of all pairs."""
    monkeypatch.setattr(stars, "VALUES", 200)
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(1 << 40))
    base = [word() for _ in range(40)]
    texts = [[word() if rng.random() < (0.03 if i % 2 else 0.5) else w for w in base] for i in range(160)]
    sets = [{tuple(t[k : k + 5]) for k in range(36)} for t in texts]
    of = [i % 20 * 3 if i % 3 else i for i in range(160)]
    near = spark.createDataFrame([(i, 0, of[i], len(sets[i])) for i in range(160)], "id bigint, group bigint, component bigint, size int")
    rows = spark.createDataFrame([(i, " ".join(t).encode()) for i, t in enumerate(texts)], "id bigint, text binary")
    got = {frozenset((of[r.a], of[r.b])) for r in stars.inside(near, rows, jaccard._sets, 75, 100).collect()}
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {frozenset((of[i], of[j])) for i, j in itertools.combinations(range(160), 2) if of[i] != of[j] and link(sets[i], sets[j])}
    assert got == want and want


def test_sets_with_values_of_their_own_make_no_product_of_all_values():
    """2,000 sets with 40 values each that no other set has, and a few in common: all pairs cost far
    less than a product over 80,000 values (some 10 s of a core)."""
    rng = np.random.default_rng(2)
    stock = rng.integers(1, 1 << 62, 30).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(stock)[:4], rng.integers(1, 1 << 62, 40).astype(np.uint64))) for _ in range(2000)]
    began = time.process_time()
    got = stars.similar_sets(75, 100)(sets, sets)
    took = time.process_time() - began
    assert (got == np.eye(2000, dtype=bool)).all() and took < 5, took
