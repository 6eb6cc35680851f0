"""The pipeline's stages against brute force, and its shape."""

from __future__ import annotations

import random

import pytest
from helpers import documents, edited, prose, save
from test_copies import brute_copies, brute_lines
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from marketframe.llm import packing


def corpus(spark):
    r, rows, labels = random.Random(8), [], []
    for i in range(150):
        text = "\n".join(prose(1000 * i + k, r.randint(6, 40)) for k in range(r.randint(1, 5)))
        bad = i % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    rows += [(200 + i, edited(rows[1][1], i, i)) for i in range(8)] + [(300, rows[2][1]), (301, rows[2][1] + "\nOne more line of five words.")]
    rows += [(400, None), (401, ""), (None, rows[3][1]), (402, prose(9, 4000)), (7, rows[7][1])]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_stages_are_four_operators_and_end_in_packing():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "packing"]
    assert entry.queries()["pipeline"] is not None and corpus_pipeline.ORACLE_SQL is None


def test_every_stage_equals_brute_force(spark, tmp_path):
    docs, labels = corpus(spark)
    path = save(tmp_path, documents=docs, labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, path).persist()
    kept = [(r.doc_id, r.text) for r in good.collect()]
    shouted = {i for i in range(0, 150, 5)}
    assert len(shouted & {k for k, _ in kept}) <= 2 and len([k for k, _ in kept if k is not None and k < 150 and k % 5]) >= 115

    left = stages["lines"](spark, good, path).persist()
    want = [(k, t) for k, t in brute_lines(kept)]
    before = {(k, t) for k, t in kept}
    want = [(k, t) for k, t in want if (k, t) in before or t.strip()]
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in left.collect() if r.text is not None)

    one = stages["near_copies"](spark, left, path).persist()
    first = {k for k, _, c in brute_copies(got) if k is not None and k == c}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted({k for k, _ in rows if k is not None}) == sorted(first) and len([k for k, _ in rows if k is not None]) == len(first)
    assert [k for k, _ in rows if k is None] == [k for k, _ in got if k is None]

    plain = Tokenizer.from_file(packing.TOKENIZER)
    packed = stages["packing"](spark, one, path).collect()
    tokens = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in packed) == tokens and len({r.sequence_id for r in packed}) == len(packed)
    for name in ("quality", "lines", "near_copies"):
        assert stages[name](spark, docs, path).columns == corpus_pipeline.COLUMNS
    whole = corpus_pipeline.run(spark, path)
    assert sorted((r.ids_crc32 for r in whole.collect())) == sorted(r.ids_crc32 for r in packed)


def test_empty_documents(spark, tmp_path):
    docs, labels = corpus(spark)
    path = save(tmp_path, documents=docs.limit(0), labels=labels.limit(0))
    assert corpus_pipeline.run(spark, path).count() == 0


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)])
def test_each_operator_has_a_query(name):
    assert len([q for q in entry.queries() if q.startswith(name)]) == 1
