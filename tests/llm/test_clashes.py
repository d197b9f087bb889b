"""Columns of the caller's own that have the names of what the operators add, and ids that repeat with other rows."""

from __future__ import annotations

import random

import numpy as np

from farwheel.llm import langid, lines, vectors


def docs_of(spark, n=30):
    rng = random.Random(8)
    row = lambda i: (i, "\n".join(["a line that many documents share with each other", *(" ".join(rng.choice("le la une des".split() if i % 2 else "the a of and".split()) + str(rng.randrange(40)) for _ in range(30)) for _ in range(3))]), "fr" if i % 2 else "en", "s", 1, "own", 7.5, 99, i)
    return spark.createDataFrame([row(i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_lines int, n_dropped long")


def test_stages_keep_the_callers_columns(spark, tmp_path):
    import corpus_pipeline

    docs = docs_of(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.dtypes == was.dtypes
        got = docs.collect()
        assert len(got) > 20 and all((r.lang_pred, r.score, r.n_lines, r.n_dropped) == ("own", 7.5, 99, r.doc_id) for r in got)


def test_operators_replace_only_the_names_asked_for(spark):
    docs = docs_of(spark)
    told = langid.identify(docs, langid.learn(docs)).collect()
    assert all(r.lang_pred == r.lang and r.score != 7.5 and r.n_lines == 99 for r in told)
    cut = lines.dedup_lines(docs).collect()
    assert all(r.n_lines == 4 and r.n_dropped == (0 if r.doc_id == 29 else 1) and r.score == 7.5 for r in cut)
    named = lines.dedup_lines(docs, names=("before", "gone")).collect()
    assert all(r.before == 4 and r.n_lines == 99 and r.n_dropped == r.doc_id for r in named)


def test_one_id_with_several_vectors(spark):
    """Each row against all others by brute force; rows that repeat an id and its vector are one vector."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(90):
        rows.append((int(rng.integers(-3, 40)), (centre[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.1])).tolist()))
    a, b = [1.0, 0.0] + [0.0] * 14, [0.0, 1.0] + [0.0] * 14
    rows += [(1001, a), (1001, b), (1002, [0.99, 0.05] + [0.0] * 14), (1003, [0.05, 0.99] + [0.0] * 14), (1002, [0.99, 0.05] + [0.0] * 14)]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in distinct])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = vectors._labels(linked | np.eye(len(x), dtype=bool))
    least = {}
    for k, (i, _) in enumerate(distinct):
        least[label[k]] = min(least.get(label[k], i), i)
    want = sorted((i, int(linked[distinct.index((i, tuple(v)))].sum()), least[label[distinct.index((i, tuple(v)))]]) for i, v in rows)
    got = sorted(tuple(r) for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, recall=0.99999).collect())
    assert got == want
    assert [r for r in got if r[0] > 1000] == [(1001, 1, 1001), (1001, 1, 1001), (1002, 1, 1001), (1002, 1, 1001), (1003, 1, 1001)]
