"""Near-duplicate operators, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, neardup, vectors
from spindrift.llm.common import connected_components


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000 + k) for k in range(1, 50)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = union(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert got == wanted
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    docs = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(3, 200))]
        docs.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            near = list(base)
            for _ in range(r.randint(0, 4)):
                near[r.randrange(len(near))] = word()
            docs.append(" ".join(near))
    docs += [docs[0]] * 30 + [docs[0].upper(), "one two", "one  two", "", "  \n"]
    return [(k, t) for k, t in enumerate(docs)] + [(900, None), (901, None), (1, docs[1]), (None, docs[2]), (None, docs[2]), (902, "w " * 60_000)]


def brute(rows):
    sets = [frozenset(neardup.shingles(neardup.normal(t)).tolist()) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return links


@pytest.mark.parametrize("blocks", [800, 7])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", blocks)
    monkeypatch.setattr(common, "HUB_ROWS", blocks)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("class_id", "_id2", "_text2", "_text", "_key")})
    got = neardup.near_duplicates(docs).collect()
    links = brute(rows)
    count = {k: 0 for k in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = union(links, range(len(rows)))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[k]] = min(ids.get(root[k], i), i)
    wanted = sorted((str(rows[k][0]), str(ids.get(root[k])), count[k]) for k in range(len(rows)))
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == wanted
    kept = neardup.keep_one(docs.drop("class_id")).collect()
    words = [k for k, (_, t) in enumerate(rows) if t and t.split()]
    assert len([r for r in kept if r.text and r.text.split()]) == len({root[k] for k in words})
    assert len([r for r in kept if not (r.text and r.text.split())]) == len(rows) - len(words)


def test_jaccard_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    wordless = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.class_id, r.n_links, r.kept) for r in neardup.near_duplicates(wordless).orderBy("doc_id").collect()] == [(1, 0, True), (2, 0, True)]


def test_forest_depth_meets_its_recall():
    d = neardup.depth_for()
    assert neardup.meeting(d) >= neardup.SURE > neardup.meeting(d + 1)
    r, forest, met = np.random.default_rng(0), neardup.Forest(), 0
    for _ in range(200):
        shared, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        met += neardup.shared_prefix(forest.label(np.unique(np.r_[shared, a])), forest.label(np.unique(np.r_[shared, b]))) >= d
    assert met >= 196


@pytest.mark.parametrize("changed", [0, 6])
def test_prefix_is_shortened_to_the_measured_recall(spark, changed):
    """Links of near-equal texts let the audit keep long prefixes; links at the threshold make it shorten them."""
    r = random.Random(changed)
    docs = []
    for k in range(120):
        base = [f"w{k}x{r.randint(0, 9)}y{j}" for j in range(300)]
        near = list(base)
        for j in range(changed):
            near[20 + 45 * j] = "other"
        docs += [" ".join(base), " ".join(near[: 300 if changed else 299])]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    sample = neardup.audit_sample(rows, "text")
    signed = neardup.signatures(rows, "doc_id", "text", sample)
    depth, recall, evidence = neardup.measure(signed, sample)
    assert evidence == 240 and recall[depth] >= neardup.TARGET
    assert depth == neardup.DEPTH if not changed else recall[depth + 1] < neardup.TARGET or depth == neardup.DEPTH
    got = neardup.near_duplicates(rows).collect()
    assert sum(x.n_links == 1 for x in got) >= 0.99 * len(got)


def test_shingles_of_long_texts_do_not_depend_on_stretches(monkeypatch):
    words = [random.Random(4).choice(["a", "bb", "é", "日本", "x" * 40]) + str(k % 977) for k in range(9000)]
    text = neardup.normal(" ".join(words))
    whole = neardup.shingles(text)
    assert len(whole) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    monkeypatch.setattr(neardup, "_CHUNK", 100)
    assert (neardup.shingles(text) == whole).all()
    assert len(neardup.shingles("one")) == len(neardup.shingles("one two")) == 1


def points(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 24))
    for k in range(n // 3):
        x[k] = x[n // 2 + k % 40] + r.normal(size=24) * 0.07
    x[:9] = x[9]
    return x


@pytest.mark.parametrize("shard", [4000, 60])
def test_vectors_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD_BYTES", shard * 24 * 8)
    monkeypatch.setattr(vectors, "BLOCK", shard + 20)
    x = points(900)
    rows = [(k, x[k].astype("f4").tolist(), k % 3) for k in range(len(x))]
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1), (1004, x[9].tolist(), None), (1005, [], 0), (9, rows[9][1], 0), (None, rows[9][1], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))).collect()
    ok = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1], "f4").astype(float) / np.linalg.norm(np.array(rows[k][1], "f4").astype(float)) for k in ok}
    links = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    count, root = {k: 0 for k in range(len(rows))}, union(links, range(len(rows)))
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert len(links) > 200
    ids = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            ids[root[k]] = min(ids.get(root[k], i), i)
    found = sum(r.n_links for r in got)
    assert 0.98 * sum(count.values()) <= found <= sum(count.values())
    wanted = sorted((str(rows[k][0]), str(ids[root[k]])) for k in range(len(rows)))
    assert sum(a == b for a, b in zip(sorted((str(r.vec_id), str(r.component_id)) for r in got), wanted)) >= 0.98 * len(wanted)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_search_recall():
    x = np.random.default_rng(4).normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.Graph(x, np.arange(1500))
    hits = dict(vectors.search(graph, x, np.arange(1500), 0.7))
    truth = x @ x.T >= 0.7
    np.fill_diagonal(truth, False)
    assert sum(map(len, hits.values())) >= 0.98 * truth.sum() and all(truth[k][h].all() for k, h in hits.items())
    again = vectors.Graph.unpack(graph.pack())
    assert (again.nearest(x[:9], 32)[1] == graph.nearest(x[:9], 32)[1]).all()
    none = vectors.Graph(x[:0], np.arange(0))
    assert (none.nearest(x[:2], 4)[1] == -1).all() and not any(len(h) for _, h in vectors.search(none, x[:2], np.arange(2), 0.9))


def test_pipeline_stages_take_effect(spark, data, tmp_path):
    """Every stage against its own brute-force reading on the smallest tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    from tests.llm.test_text_operators import brute_hits

    stage = dict(pipeline.STAGES)
    named = stage["language"](spark, docs, data)
    assert named.columns == docs.columns and named.count() == docs.where("text rlike '\\\\p{L}'").count()
    cleaned = stage["line_dedup"](spark, docs, data)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    kept = stage["near_duplicates"](spark, docs, data).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = union(brute(rows), range(len(rows)))
    assert {r.doc_id for r in kept} == {min(rows[k][0] for k in root if root[k] == top) for top in set(root.values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, docs, data).collect()
    assert {r.doc_id for r in clean} == {i for i, t in rows if brute_hits(t, items)[1] == 0}
    packed = pipeline.run(spark, data).collect()
    assert packed and {"doc_id", "sequence_id", "length"} <= set(packed[0].asDict())


def test_pipeline_of_nothing(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


@pytest.fixture
def many_partitions(spark):
    """64 shuffle partitions that Spark doesn't put together; gives how many tasks a call runs."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)

    def tasks(name, f):
        sc = spark.sparkContext
        sc.setJobGroup(name, name)
        out = f()
        sc.setJobGroup("after", "after")
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(name)]
        stages = {s for j in jobs if j for s in j.stageIds}
        return out, sum(i.numCompletedTasks for i in map(sc.statusTracker().getStageInfo, stages) if i)

    yield tasks
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_edges_take_few_tasks(spark, many_partitions):
    """Rounds over few edges don't run (and leave shuffle files) by the number of partitions."""
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 1500)]
    got, tasks = many_partitions("components", lambda: connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {x.node: x.root for x in got} == union(pairs, {x for p in pairs for x in p})
    assert tasks < 3_000


def test_few_documents_take_few_tasks(spark, many_partitions):
    """So with a whole pass: judged copies, near copies and texts that nothing is near lie in few partitions."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    got, tasks = many_partitions("judge", lambda: neardup.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    assert tasks < 5_000
