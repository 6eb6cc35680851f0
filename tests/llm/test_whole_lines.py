"""Lines of every script and length, and what SimHash blocks find of all near lines."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from helpers import documents, edited, prose
from test_copies import brute_lines, distance, groups, line_rows, normal, result

import corpus_pipeline
from marketframe.llm import fuzzy_lines


def test_blocks_find_nine_in_ten_of_the_near_lines(spark):
    """Against the edit limit alone: lines of 20 to 90 words with one edit, or two from 40 words on."""
    r, rows = random.Random(11), []
    for i in range(150):
        n = r.randint(20, 90)
        line = prose(7000 + i, n)
        rows += [(2 * i, line), (2 * i + 1, edited(line, i, max(1, n // 40)))]
    near = [distance(normal(a[1]), normal(b[1])) <= max(len(normal(a[1])), len(normal(b[1]))) * fuzzy_lines.EDITS // 100 for a, b in itertools.batched(rows, 2)]
    out = {x.doc_id: x._removed for x in fuzzy_lines.remove_lines(documents(spark, rows)).collect()}
    found = [out[b[0]] == 1 for a, b in itertools.batched(rows, 2)]
    assert sum(near) >= 140 and not any(f and not n for f, n in zip(found, near))
    assert sum(found) >= 0.85 * sum(near)


def test_the_stage_of_the_pipeline_equals_brute_force(spark):
    rows = line_rows()
    left = dict(corpus_pipeline.STAGES)["lines"](spark, documents(spark, rows), "")
    before = set(rows)
    want = [(k, t) for k, t in brute_lines(rows) if (k, t) in before or t.strip()]
    assert result(left.select("doc_id", "text")) == sorted(want, key=repr)


def test_names_of_the_input_never_clash(spark):
    names = ["id", "row", "parts", "gone", "lines", "removed", "_maybe", "_word", "_lines", "_removed", "_key", "a.b", "keys"]
    rows = [(1, "one line\nanother line", *names), (2, "One line", *names), (None, "one line", *names), (4, None, *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = fuzzy_lines.remove_lines(df)
    kept = [n for n in names if n not in ("_lines", "_removed")]
    assert out.columns == ["doc_id", "text", *kept, "_lines", "_removed"]
    got = {r.doc_id: (r.text, r._removed) for r in out.collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 1), None: ("one line", 0), 4: (None, 0)}
    assert all(r[2:-2] == tuple(kept) for r in out.collect())


def test_short_lines_and_scripts_without_spaces(spark):
    han, thai = "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3068\u3066\u3082\u3044\u3044", "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35"
    rows = [(1, f"All rights reserved.\n{han}\n{thai}\nHome\n***"), (2, f"all rights reserved\n{han}\n{thai}\n***"), (3, han[:5] + "\u6691" + han[6:]),
            (4, han[:3] + thai[:9] + "x"), (5, "HOME\nAway\n\u00e9cole"), (6, "\u00c9cole\n\u00e9cole\nHome page")]
    out = {r.doc_id: r.text for r in fuzzy_lines.remove_lines(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "***", 3: rows[2][1], 4: rows[3][1], 5: "Away\n\u00e9cole", 6: "\u00c9cole\nHome page"}


def test_characters_of_scripts_without_spaces_are_words():
    text = "ab\u4e00\u4e8ccd \u0e01e\n\u00e9\U00020000\U00020001 \ud55c\uad6d \u1200\u1201 x"
    for cut in (text, text[:4], "\u4e00", ""):
        raw = cut.encode() * 2
        start, end = fuzzy_lines.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw) // 2, len(raw)]))
        one = [raw[a:b].decode() for a, b in zip(start, end)]
        assert one == 2 * [w for w in "ab \u4e00 \u4e8c cd \u0e01 e \u00e9 \U00020000 \U00020001 \ud55c\uad6d \u1200\u1201 x".split() if w in cut][: len(one) // 2]
        assert "".join(one[: len(one) // 2]) == cut.replace(" ", "").replace("\n", "")


def test_lines_that_differ_in_their_figures_stay(spark):
    rows = [(1, "12 34 56 78\n98 76 54 32\nPage 1 of 20 pages\nPage 7 of 93 pages\nItem 1\nItem 2"), (2, "12 34 56 78\nPage 1 of 21 pages")]
    out = {r.doc_id: r.text for r in fuzzy_lines.remove_lines(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: ""}


def test_parities_of_words_keep_all_that_is_within_the_edit_limit():
    """Pairs that many edits apart are told by a number, before their words are sent anywhere."""
    r, told = random.Random(4), 0
    for i in range(300):
        x = [r.randrange(1, 1 << 62) for _ in range(r.randint(20, 120))]
        y, most = list(x), len(x) * fuzzy_lines.EDITS // 100
        for _ in range(r.choice([most, 3 * most])):
            at, kind = r.randrange(len(y)), r.randrange(3)
            y[at : at + (kind > 0)] = [r.randrange(1, 1 << 62)] * (kind < 2)
        first = np.cumsum([0, len(x), 0, len(y)])
        odd = fuzzy_lines.parities(np.array(x + y, np.uint64), first)
        most = max(len(x), len(y)) * fuzzy_lines.EDITS // 100
        apart = int(odd[0] ^ odd[2]).bit_count() if odd[0] ^ odd[2] >= 0 else int((odd[0] ^ odd[2]).view(np.uint64)).bit_count()
        fits = apart <= 2 * most - abs(len(x) - len(y))
        near = fuzzy_lines.within_edits(np.array(x, np.uint64), np.array(y, np.uint64), most)
        assert odd[1] == 0 and (fits or not near)
        told += not fits
    assert told >= 100


def test_pairs_that_are_alike_in_bits_only_are_not_compared_by_words(spark, monkeypatch):
    """Sixty versions of one line, each with its own five words, share blocks; few of them link."""
    line, asked = prose(31, 100), []
    rows = [(i, edited(line, 100 + i, 5)) for i in range(60)]
    plain = fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda pairs, *rest: (asked.append(pairs.count()), plain(pairs, *rest))[1])
    assert result(fuzzy_lines.remove_lines(documents(spark, rows)).select("doc_id", "text")) == brute_lines(rows)
    assert sum(asked) <= 400, asked


def test_lines_of_one_group_are_compared_until_they_are_connected(monkeypatch):
    """Ninety lines, each an edit from one of them: connected by about a comparison each, not by all pairs."""
    r, asked, plain = random.Random(3), [], fuzzy_lines.within_edits
    base = [r.randrange(1, 1 << 62) for _ in range(60)]
    lines = [base] + [base[:i] + [r.randrange(1, 1 << 62)] + base[i + 1 :] for i in range(60)] + [base[:i] + base[i + 1 :] for i in range(29)]
    words, first = np.concatenate([np.array(x, np.uint64) for x in lines]), np.cumsum([0, *map(len, lines)])
    sims = fuzzy_lines.simhashes(words, first)
    columns = {"key": [1] * 90, "part": [0] * 90, "side": [-1] * 90, "id": [*range(90)], "size": np.diff(first)}
    columns |= {"odd": fuzzy_lines.parities(words, first), "sim0": sims[:, 0], "sim1": sims[:, 1], "words": [np.array(x, np.uint64).tobytes() for x in lines]}
    rows = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    monkeypatch.setattr(fuzzy_lines, "within_edits", lambda *x: (asked.append(1), plain(*x))[1])
    links = pa.Table.from_batches([*fuzzy_lines.linked(iter([rows.slice(0, 40), rows.slice(40)]))]).to_pylist()
    size, odd = columns["size"], columns["odd"]
    far = lambda a, b: fuzzy_lines.alike(size[a], odd[a], sims[a], size[[b]], odd[[b]], [sims[[b], 0], sims[[b], 1]])[0] > fuzzy_lines.BITS
    pairs = [(a, b) for a, b in itertools.combinations(range(90), 2) if distance(lines[a], lines[b]) <= 3 and not far(a, b)]
    assert len(pairs) >= 1000 and len(links) <= 89 and len(asked) <= 180
    assert groups(90, [(x["a"], x["b"]) for x in links]) == groups(90, pairs)


def test_a_neighbourhood_dealt_over_parts_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "PART", 6)
    rows = [(i, edited(prose(31, 60), 100 + i, 1 + i % 3)) for i in range(40)]
    assert result(fuzzy_lines.remove_lines(documents(spark, rows)).select("doc_id", "text")) == brute_lines(rows)
