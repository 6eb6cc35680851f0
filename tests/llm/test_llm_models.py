"""The quality classifier, language models and the vector forest."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from helpers import awkward_texts, documents, prose
from pyspark.sql import functions as F

from marketframe.llm import ann_forest, cross_entropy, quality


def rated(spark, n=400):
    """Good prose, shouted prose and one word over and over; labels of most rows."""
    rows, labels = [], []
    for i in range(n):
        text, good = prose(i, 30 + i % 50), i % 3 > 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " ".join([text.split()[0]] * 40)
        rows.append((i, text))
        if i % 10:
            labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, " "), (None, "no key"), (1003, prose(5000, 9000)), (3, prose(3, 33))]
    labels += [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_scored_well_and_never_learned_from(spark):
    docs, labels = rated(spark)
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    rows = [r for r in out.select("doc_id", "score", quality.is_held_out().alias("held")).collect()]
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held and r.doc_id < 400]
    right = sum((r.score >= quality.THRESHOLD) == (r.doc_id % 3 > 0) for r in held)
    assert len(held) > 60 and right / len(held) > 0.9
    turned = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, turned)).collect() if r.doc_id != 3}
    assert all(again[r.doc_id] == r.score for r in rows if r.doc_id != 3)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0).cast("bigint")})
    assert {r.score for r in quality.score(other, model).collect()} == {r.score for r in rows}


def test_without_labels_of_both_kinds_the_share_is_the_score(spark):
    docs, labels = rated(spark, 30)
    for few, want in ((labels.limit(0), 0.5), (labels.where("quality = 1 AND doc_id > 10"), 1.0)):
        model = quality.fit(docs, few)
        assert {r.score for r in quality.score(docs, model).collect()} == {want}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_a_document_scores_the_same_in_any_company():
    texts = [prose(i, 20 + i).encode() for i in range(30)] + [b"", ("word " * 40_000).encode()]
    h, first = quality.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    words = quality.WordVectors.fit(h, first)
    together = words.pooled(h, first)
    for i, t in enumerate(texts):
        alone = words.pooled(*quality.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
        assert np.allclose(alone[0], together[i], atol=1e-5)
    assert np.isfinite(together).all() and not together[30, : 2 * quality.WIDTH].any()


def test_tokens_split_words_from_signs():
    raw = "Ab!! c|d\n é9...".encode()
    h, first = quality.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(h) == 7 and len(set(h.tolist())) == 7 and first.tolist() == [0, 7]


def tokenised(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_losses(rows, good):
    """Interpolated bigram models in plain Python, without the scored row's own words."""
    texts, target = [tokenised(t) for _, t in rows], [k in good for k, _ in rows]
    signs, losses = len({w for t in texts for w in t}) + 1, []
    for i, own in enumerate(texts):
        corpora = [[t for j, t in enumerate(texts) if j != i and (every or target[j])] for every in (False, True)]
        sizes = [sum(map(len, c)) for c in corpora]
        means = []
        for corpus, size in zip(corpora, sizes):
            word = Counter(w for t in corpus for w in t)
            past = Counter(h for t in corpus for h in [None, *t][: len(t)])
            pair = Counter(p for t in corpus for p in zip([None, *t], t))
            scale, loss = (sizes[0] / max(size, 1) if corpus is corpora[1] else 1.0), 0.0
            for h, w in zip([None, *own], own):
                unigram = (word[w] * scale + 1) / (sizes[0] + signs)
                p = cross_entropy.WEIGHT * pair[h, w] / past[h] + (1 - cross_entropy.WEIGHT) * unigram if past[h] else unigram
                loss -= log(p)
            means.append(loss / len(own) if own else None)
        losses.append(means)
    return losses


def test_losses_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "BLOCK", 20_000)
    monkeypatch.setattr(cross_entropy, "PART", 5_000)
    rows = [(i, t) for i, (_, t) in enumerate(awkward_texts())]
    rows[7], rows[9] = (None, rows[7][1]), (None, "no key but words")
    good = {1, 3, 5, 30, 31, 32}
    target = spark.createDataFrame([(k,) for k in [*good, 1, None]], "doc_id bigint")
    want = brute_losses(rows, good)
    found = {r.doc_id: r for r in cross_entropy.cross_entropy_difference(documents(spark, rows), target).collect()}
    assert set(found) == {k for k, _ in rows}
    for (k, text), (a, b) in zip(rows, want):
        if k is None:
            continue
        r = found[k]
        assert r.n_tokens == len(tokenised(text))
        if a is None:
            assert r.target_loss is None and r.background_loss is None and r.score is None
        else:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((a, b, a - b), rel=1e-9)


def test_a_score_says_likeness_not_membership(spark):
    """Good prose scores alike, whether or not it is in the target."""
    rows = [(i, prose(i, 200) if i % 3 else " ".join(prose(i, 200).upper().replace("E", "x").split()[::-1])) for i in range(120)]
    target = spark.createDataFrame([(k,) for k, _ in rows if k % 3 and k % 2], "doc_id bigint")
    scores = {r.doc_id: r.score for r in cross_entropy.cross_entropy_difference(documents(spark, rows), target).collect()}
    inside, outside, other = ([scores[k] for k, _ in rows if c(k)] for c in (lambda k: k % 3 and k % 2, lambda k: k % 3 and not k % 2, lambda k: not k % 3))
    assert abs(np.mean(inside) - np.mean(outside)) < np.std(outside) and min(other) > max(outside)


def test_empty_corpora(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint")
    assert cross_entropy.cross_entropy_difference(docs.limit(0), none).count() == 0
    out = cross_entropy.cross_entropy_difference(docs, none)
    assert out.count() == docs.count()
    out = out.where("n_tokens > 0")
    assert out.count() > 0 and out.where("score IS NULL OR isnan(score)").count() == 0


def test_quality_takes_any_column_names(spark):
    docs, labels = rated(spark, 60)
    named = docs.withColumns({"_text": F.lit("x"), "text_": F.lit(1), "TEXT__": F.lit(2)})
    out = quality.score(named, quality.fit(named, labels))
    assert set(out.columns) == set(named.columns) and out.where("_text != 'x'").count() == 0 and out.count() == docs.count()


def vectors(spark, n=900, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, (n, 1))
    if n > 300:
        x[50:250] = x[50]  # one very common vector
        x[260:300] = x[50] * (1 + 1e-3 * rng.normal(size=(40, dim)))
    rows = [(i, [float(np.float32(v)) for v in row], "a", 1.0) for i, row in enumerate(x)]
    rows += [(2000, None, "a", 1.0), (2020, [0.0] * dim, "a", 1.0), (2040, [float("nan")] * dim, "a", 1.0),
             (2060, [float("inf")] + [1.0] * (dim - 1), "a", 1.0), (2080, [None] + [1.0] * (dim - 1), "a", 1.0), (2100, [1.0, 2.0], "a", 1.0),
             (None, [1.0] * dim, "a", 1.0), rows[-1], rows[n // 2]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string, score double")
    return df, {r[0]: np.array(r[1]) for r in rows[:n]}


def brute_nearest(x, query, most):
    keys = np.array([k for k in x if k != query])
    scores = np.array([x[k] @ x[query] for k in keys])
    order = np.lexsort((keys, -scores.round(9)))[:most]
    return [(int(keys[i]), float(scores[i])) for i in order]


def check_answers(df, x, found, most, least):
    by = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = {k for k in x if k % 20 == 0}
    assert set(by) == asked
    hits = total = 0
    for q, rows in by.items():
        rows.sort()
        want = brute_nearest(x, q, most)
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx(x[k] @ x[q], abs=1e-9) and k != q for _, k, s in rows)
        assert len({k for _, k, _ in rows}) == len(rows)
        hits += sum(s >= want[-1][1] - 1e-9 for _, _, s in rows)
        total += len(want)
    assert hits / total >= least
    return by


def test_forest_finds_most_neighbours_of_vectors_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "ALL", 16)
    monkeypatch.setattr(ann_forest, "BLOCK", 64)  # several blocks a tree, and parts of blocks
    monkeypatch.setattr(ann_forest, "QUERIES", 16)  # several rounds of queries
    df, x = vectors(spark)
    check_answers(df, x, ann_forest.nearest(df, df.where("vec_id % 20 = 0")), 20, 0.9)


def test_small_tables_are_compared_whole_and_ties_go_to_the_smaller_key(spark):
    df, x = vectors(spark, 400)
    by = check_answers(df, x, ann_forest.nearest(df, df.where("vec_id % 20 = 0")), 20, 1.0)
    for q, rows in by.items():
        assert [k for _, k, _ in rows] == [k for k, _ in brute_nearest(x, q, 20)]
    few, y = vectors(spark, 9)
    check_answers(few, y, ann_forest.nearest(few, few.where("vec_id % 20 = 0")), 20, 1.0)
    assert ann_forest.nearest(df.limit(0), df).count() == 0
    one = df.where("vec_id = 40")
    assert ann_forest.nearest(one, one).count() == 0


def test_a_query_ascends_until_its_prefixes_hold_enough(spark):
    queries = spark.createDataFrame([(1, [0b1011 << 28, 0b0001 << 28])], "id bigint, hashes array<bigint>")
    counts = [(t, level, p, n) for t, path in ((0, [1, 0b10, 0b101]), (1, [0, 0, 0])) for level, p, n in
              [(0, 0, 100), (1, path[0], 40), (2, path[1], 15 + t), (3, path[2], 4)]]
    counts = spark.createDataFrame(counts, "tree int, level int, prefix bigint, n bigint")
    level = lambda wanted: [r.level for r in ann_forest.levels_of(queries, counts, wanted, 3).orderBy("tree").collect()]
    assert level(8) == [3, 3] and level(9) == [2, 3] and level(19) == [2, 3] and level(20) == [2, 2]
    assert level(32) == [1, 2] and level(200) == [0, 0] and level(500) == [0, 0]


def test_what_word_vectors_need_beside_the_sample_is_bounded():
    import tracemalloc

    import numpy as np

    from marketframe.llm import quality

    h = np.random.default_rng(1).integers(0, 3000, 2_000_000).astype(np.uint64)
    first = np.arange(0, len(h) + 1, 500)
    tracemalloc.start()
    quality.WordVectors.fit(h, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * h.nbytes


def test_bigrams_of_one_document_are_not_stored(spark, monkeypatch):
    """Of bigrams that no other document holds nothing goes to shared storage; words do, for the models' sizes."""
    monkeypatch.setattr(cross_entropy, "BLOCK", 4_000)
    rows = [(i, " ".join(f"w{i}x{k} shared" for k in range(40))) for i in range(20)]
    kinds, plain = Counter(), cross_entropy.materialise

    def kept(df):
        out = plain(df)
        if "key" in out.columns:
            kinds.update(r.key & 3 for r in out.select("key").collect())
        return out

    monkeypatch.setattr(cross_entropy, "materialise", kept)
    out = cross_entropy.cross_entropy_difference(documents(spark, rows), documents(spark, rows[:5]).select("doc_id"))
    assert out.count() == 20 and kinds[cross_entropy.PAIR] == 0 and kinds[cross_entropy.WORD] >= 801


def test_counts_of_bigrams_meet_in_few_rows_and_come_back_without_their_keys(spark, monkeypatch):
    """Blocks send ranges of keys with their counts, not a row for each of their bigrams."""
    monkeypatch.setattr(cross_entropy, "BLOCK", 4_000)
    rows = [(i, " ".join(f"w{i % 7}x{k} shared" for k in range(200))) for i in range(20)]
    stored, plain = [], cross_entropy.materialise
    monkeypatch.setattr(cross_entropy, "materialise", lambda df: (out := plain(df), stored.append((out.columns, out.count())))[0])
    out = cross_entropy.cross_entropy_difference(documents(spark, rows), documents(spark, rows[:5]).select("doc_id"))
    assert out.count() == 20 and max(n for _, n in stored) <= 2000, stored
    for x in (np.array([0, 0]), np.array([1, 300, 0, 2**40 + 7]), np.array([], np.int64), np.array([2**64 - 1, 0], np.uint64)):
        raw = cross_entropy.planes(x)
        assert cross_entropy.unplaned(raw, len(x)).tolist() == x.tolist()
    assert len(cross_entropy.planes(np.array([7, 255, 0]))) == 3
