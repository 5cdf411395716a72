"""Operators do the whole job: cases where a cap, an audit without evidence or a key by ids alone lost rows or links."""

import numpy as np
import pytest

from spindrift.llm import neardup, packing, vectors


def test_neighbours_score_all_terms():
    """Against plain BM25 over every distinct term of the seed, while documents are used up."""
    r = np.random.default_rng(1)
    docs = [r.integers(0, 400, n).astype("<u2") for n in r.integers(60, 700, 50)]
    df = np.bincount(np.concatenate([np.unique(t) for t in docs]), minlength=1 << 16)
    idf = np.log(1 + (50 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    index, unused = packing.Shard(docs, idf, mean), np.ones(50, bool)
    for seed in range(40):
        unused[seed] = False
        score = np.zeros(50)
        for k, x in enumerate(docs):
            t, tf = np.unique(x, return_counts=True)
            w = idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
            score[k] = w[np.isin(t, docs[seed])].sum()
        got = index.neighbours(seed, unused)
        assert sorted(got) == np.flatnonzero((score > 0) & unused).tolist()
        assert (np.diff(score[got]) <= 1e-3).all()


def test_keep_one_goes_by_component(spark):
    a, b, c = ("abcdefghijklmnopqrst"[k] * 3 for k in range(3))
    text = lambda w: " ".join(f"{w}{k}" for k in range(60))
    near = text(c) + " more"
    rows = [(None, text(a)), (None, text(a)), (None, text(b)), (None, text(b)), (None, text(c)), (None, near), (None, ""), (None, ""), (None, None), (7, "seven alone"), (7, text("x")), (7, text("x")), (8, text("x"))]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=repr)
    third = [t for t in (text(c), near) if (None, t) in got]
    assert len(third) == 1
    wanted = [(None, text(a)), (None, text(b)), (None, third[0]), (None, ""), (None, ""), (None, None), (7, "seven alone"), (7, text("x"))]
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("group", [0, 1500])
def test_search_finds_rare_links(monkeypatch, group):
    """A few pairs among vectors without links, alone and beside a large group that the graph finds easily."""
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 48))
    x[:group] = x[0] + r.normal(size=(group, 48)) * 0.01
    x[1991:2000:2] = x[1990:2000:2][:5] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(2000)
    graph = vectors.Graph(x, ids)
    hide = np.arange(2000) >= 1000  # a search that never finds the second half: probes tell
    nearest = graph.nearest
    monkeypatch.setattr(graph, "nearest", lambda q, width: (lambda s, i: (np.where(hide[i], -1, s), np.where(hide[i], -1, i)))(*nearest(q, width)))
    truth = x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    assert truth[1990:].sum() == 10
    for blind in (True, False):
        hits = dict(vectors.search(graph, x, ids, 0.93))
        assert all(np.array_equal(hits.get(k, []), np.flatnonzero(t)) for k, t in enumerate(truth)), blind
        monkeypatch.undo()


def test_search_falls_back_when_the_audit_fails(monkeypatch):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(500, 24)), 2, axis=0) + r.normal(size=(1000, 24)) * 0.001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.Graph(x, np.arange(1000))
    monkeypatch.setattr(graph, "nearest", lambda q, width: (np.full((len(q), width), -1.0), np.full((len(q), width), -1)))
    hits = dict(vectors.search(graph, x, np.arange(1000), 0.93))
    assert [hits[k].tolist() for k in range(1000)] == [[k ^ 1] for k in range(1000)]
