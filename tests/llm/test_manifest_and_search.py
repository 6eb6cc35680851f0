"""Merkle manifests, ranked search and MinHash copies against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter
from math import floor, log

import pytest
from helpers import awkward_texts, documents, edited, prose
from pyspark.sql import functions as F
from test_copies import groups, lowered, result

from marketframe.llm import merkle, minhash, ranked, stars


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    """``leaf, subroot, root, proof`` of each row (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [sha(*[field(r[k]) for k in (0, 3, 2, 4, 1)]) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i])) for s in sources}
    trees = {s: levels([leaf[i] for i in order[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])

    def siblings(tree, at):
        out = []
        for nodes in tree[:-1]:
            a = at // 16 * 16
            out += [n for k, n in enumerate(nodes[a : a + 16], a) if k != at]
            at //= 16
        return out

    found = []
    for n, s in enumerate(sources):
        for at, i in enumerate(order[s]):
            proof = sha(*siblings(trees[s], at), *siblings(top, n))
            found.append((rows[i][0], leaf[i], trees[s][-1][0], top[-1][0], proof))
    return sorted(found, key=repr)


def manifest_rows(n):
    r = random.Random(n)
    rows = [(i, prose(i, 5), "en", r.choice(["b", "b", "b", "a", None, "\u00e9"]), i) for i in range(n)]
    rows += [(5, "again", None, "b", None), (5, "again", None, "b", None), (None, None, "en", "b", 1), (None, "", "en", None, 1), (7, "x" * 100_000, "de", "", 2)]
    return rows + [(1000 + i, "lone", "en", f"src{i}", 4) for i in range(40)]


@pytest.mark.parametrize("n", [0, 17, 700])
def test_manifest_equals_brute_force(spark, n):
    rows = manifest_rows(n)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("tree", F.lit("extra"))
    proofs = merkle.build(df.repartition(5), probe={"text": F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))}).proofs()
    proofs = proofs.withColumns({"proof": F.sha2(merkle.siblings(F.col("path")), 256), "own": merkle.folded(F.col("path"), F.col("leaf")), "tried": merkle.folded(F.col("path"), F.col("probe"))}).persist()
    assert result(proofs.select("doc_id", "leaf", "subroot", "root", "proof")) == brute_manifest(rows)
    assert proofs.where("own != root").count() == 0
    changed = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0 and r[1] != r[1].upper()}
    assert {r.doc_id for r in proofs.where("tried != root").collect()} == changed


def test_only_every_second_level_is_stored(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), *[F.lit(c).alias(c) for c in ("text", "lang", "source")], F.lit(1).alias("n_chars"))
    built = merkle.build(df)
    assert [x.count() for x in built.sources] == [5000, 20, 1] and built.root().count() == 1
    empty = merkle.build(df.limit(0))
    assert empty.proofs().count() == 0 and empty.root().count() == 0
    one = merkle.build(df.limit(1)).proofs().collect()
    assert len(one) == 1 and one[0].leaf == one[0].root and one[0].path == []


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(text))


def brute_ranks(rows, queries, top):
    docs = [(k, Counter(terms(t)), len(terms(t))) for k, t in rows]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        scores = []
        for k, tf, size in docs:
            m = 25 + 75 * size * n // total
            score = sum(c * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in Counter(terms(text)).items() if t in tf)
            if score > 0:
                scores.append((-score, k is None, k or 0, k))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "first"), [(1 << 16, 2000), (40, 5)])
def test_ranks_equal_brute_force(spark, monkeypatch, most, first):
    monkeypatch.setattr(ranked, "FIRST", first)
    monkeypatch.setattr(ranked, "GROWTH", 3)
    rows = awkward_texts()
    queries = [(1, "the of and river"), (2, "Stone stone CLOUD cloud77"), (3, None), (4, ""), (5, "nowhere to be found?"), (6, prose(1, 40)), (6, prose(1, 40)), (7, "\u00c9cole x")]
    items = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("rank", F.lit("extra"))
    got = ranked.ranked_search(documents(spark, rows), items, most=most)
    assert result(got) == brute_ranks(rows, queries, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert ranked.ranked_search(documents(spark).limit(0), items).count() == 0
    assert ranked.ranked_search(documents(spark), items.limit(0)).count() == 0
    assert ranked.ranked_search(documents(spark, [(1, None), (2, "--")]), items).count() == 0


def test_rounds_cover_every_bucket_once():
    sizes = [(b, 10 ** (b % 5)) for b in range(-40, 40, 3)]
    spans = ranked.rounds(sizes)
    assert [sum(a <= b <= z for a, z in spans) for b, _ in sizes] == [1] * len(sizes) and ranked.rounds([]) == []


def brute_duplicates(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group, lowest = groups(len(rows), links), {}
    for g, (k, _) in zip(group, rows):
        if k is not None:
            lowest[g] = min(k, lowest.get(g, k))
    return sorted(((k, len(s), lowest.get(g), k is not None and k == lowest.get(g)) for (k, _), s, g in zip(rows, sets, group)), key=repr)


def test_duplicates_equal_brute_force(spark):
    rows = awkward_texts()
    assert result(minhash.near_duplicates(documents(spark, rows))) == brute_duplicates(rows)
    assert minhash.near_duplicates(documents(spark).limit(0)).count() == 0
    only = documents(spark, [(1, None), (2, ""), (3, "one")])
    assert result(minhash.near_duplicates(only)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """200 variants of one text, whose pairs lie around the limit."""
    monkeypatch.setattr(stars, "PART", 16)
    base = prose(3, 150)
    rows = [(i, edited(base, i, 5 + i % 6)) for i in range(200)] + [(500 + i, prose(900 + i, 60)) for i in range(40)]
    assert result(minhash.near_duplicates(documents(spark, rows))) == brute_duplicates(rows)
