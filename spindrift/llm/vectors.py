"""Embedding near-dedup (operator 2): hierarchical navigable small-world graphs per shard, exact cosine, components.

Vectors are dealt out in shards within their label. A shard's graph is built by inserting its vectors one batch
after another: each finds its neighbours by searching the graph as it stands, its own batch besides. Every shard
is queried by blocks of all vectors of its label. Searches of a batch run in step, so that NumPy does the work.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, hub_join, runs, table

COSINE = 0.93
#: Bytes of vectors in a shard, about (every shard is searched by all vectors of its label, so few large ones
#: are better than many small ones), and queries in a block.
SHARD_BYTES, BLOCK = 8 << 20, 4_000
#: Ties that a vector makes at each level (it may hold twice as many at the lowest), the share of vectors that
#: a level passes on, and the beam of an insertion.
NEIGHBOURS, LEVEL, INSERT_BEAM = 12, 16, 32
#: Vectors inserted, or queries searched, in step; beam members expanded at a time.
STEP, EXPAND = 256, 6
#: The audit of a block: probes at the threshold from random members, queries answered by a full scan besides,
#: and the mean share of its links that either must find.
PROBES, AUDIT, RECALL = 96, 96, 0.99
BEAMS = (32, 64, 128, 256, 512)
#: How far single precision may be from a cosine.
_SLACK = 1e-5


def _sorted_top(sims: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` best of each row, best first; ties by place."""
    if sims.shape[1] > n:
        at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Graph:
    """A hierarchical small-world graph over unit vectors, built by insertion.

    Level 0 holds every vector, each further one about a sixteenth of the last. In each level a new vector is
    tied to those that its search found and that are nearer to it than to a tie already made (so ties also
    lead out of a dense group), then to the nearest of the rest; ties go both ways, and a vector with too
    many keeps some by the same rule.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, ties: list[np.ndarray] | None = None):
        self.v, self.ids, self.x = vectors, ids, vectors.astype(np.float32)
        n = len(ids)
        rank = np.random.default_rng(5).random(n)
        height = np.minimum(np.floor(-np.log(np.maximum(rank, 1e-12)) / np.log(LEVEL)).astype(int), 8)
        self.top = int(height.max()) if n else 0
        self.entry = int(height.argmax()) if n else -1
        if ties is not None:
            self.ties = ties
            return
        # Level 0 has room for twice the ties. Upper levels keep a row for every vector, which is simple and small.
        self.ties = [np.full((n, 2 * NEIGHBOURS if level == 0 else NEIGHBOURS), -1, np.int32) for level in range(self.top + 1)]
        order = np.r_[self.entry, np.delete(np.arange(n), self.entry)] if n else np.zeros(0, int)
        at, size = 1, 1
        while at < n:
            part = order[at : at + size]
            self._insert(part, height[part])
            at += len(part)
            size = min(STEP, at)

    def _insert(self, new: np.ndarray, height: np.ndarray) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry, np.int64)
        for level in range(self.top, -1, -1):
            here = height >= level
            sims, ids = self._beam(q, start, INSERT_BEAM if here.any() else 1, level)
            start = ids[:, :1]
            if not here.any():
                continue
            mine, q1 = new[here], q[here]
            own = q1 @ q1.T
            np.fill_diagonal(own, -np.inf)
            sims = np.concatenate([sims[here], own], axis=1)
            ids = np.concatenate([ids[here], np.broadcast_to(mine, own.shape)], axis=1)
            self._tie(level, mine, *_sorted_top(sims, ids, INSERT_BEAM))

    def _choose(self, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Which candidates (best first) become ties: the diverse ones, then the nearest of the rest."""
        x = self.x[np.maximum(ids, 0)]
        among = np.matmul(x, x.transpose(0, 2, 1))
        kept = np.zeros(sims.shape, bool)
        nearest = np.full(sims.shape, -np.inf, np.float32)  # to a tie already made
        count = np.zeros(len(sims), int)
        for j in range(sims.shape[1]):
            ok = (sims[:, j] > nearest[:, j]) & (ids[:, j] >= 0) & np.isfinite(sims[:, j]) & (count < most)
            kept[:, j] = ok
            count += ok
            nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j, :]), nearest)
        rest = ~kept & (ids >= 0) & np.isfinite(sims)
        return kept | (rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None]))

    def _tie(self, level: int, mine: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        ties = self.ties[level]
        kept = self._choose(sims, ids, NEIGHBOURS)
        a, b = np.repeat(mine, kept.sum(axis=1)), ids[kept].astype(np.int64)
        both = np.unique(np.concatenate([a * len(ties) + b, b * len(ties) + a]))
        node, other = both // len(ties), both % len(ties)
        touched, first, added = np.unique(node, return_index=True, return_counts=True)
        old = ties[touched]
        had = (old >= 0).sum(axis=1)
        row = np.repeat(np.arange(len(touched)), added)
        place = np.arange(len(node)) - np.repeat(first, added) + np.repeat(had, added)
        wide = np.full((len(touched), max(int((had + added).max()), ties.shape[1])), -1, np.int64)
        wide[:, : ties.shape[1]] = old
        wide[row, place] = other
        full = had + added > ties.shape[1]
        ties[touched[~full]] = wide[~full, : ties.shape[1]]
        for at in range(0, int(full.sum()), STEP):
            some = np.flatnonzero(full)[at : at + STEP]
            ids = wide[some]
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(ids, 0)], self.x[touched[some]]), -np.inf)
            sims, ids = _sorted_top(sims, ids, 2 * ties.shape[1])
            kept = self._choose(sims, ids, ties.shape[1])
            new = np.full((len(some), ties.shape[1]), -1, np.int64)
            r, c = np.nonzero(kept)
            new[r, np.cumsum(kept, axis=1)[r, c] - 1] = ids[r, c]
            ties[touched[some]] = new

    def _beam(self, q: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` that a search from ``start`` (a row each) finds for each query, best first; -1 where fewer."""
        n, ties = len(self.x), self.ties[level]
        seen = np.zeros(len(q) * n, bool)
        width = max(width, start.shape[1])
        sims = np.full((len(q), width), -np.inf, np.float32)
        ids = np.full((len(q), width), -1, np.int64)
        done = np.ones((len(q), width), bool)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(start, 0)], q), -np.inf)
        done[:, : start.shape[1]] = start < 0
        r, c = np.nonzero(start >= 0)
        seen[r * n + start[r, c]] = True
        active = np.arange(len(q))
        few = min(EXPAND, width)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_sims, few - 1, axis=1)[:, :few] if width > few else np.broadcast_to(np.arange(width), open_sims.shape)
            live = np.isfinite(np.take_along_axis(open_sims, pick, 1))
            going = live.any(axis=1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            r, c = np.nonzero(live)
            r, c = active[r], pick[r, c]
            done[r, c] = True
            near = ties[ids[r, c]]
            ok = near >= 0
            flat = (r[:, None] * n + near)[ok]
            flat = np.sort(flat[~seen[flat]])
            flat = flat[np.r_[True, flat[1:] != flat[:-1]]] if len(flat) else flat
            seen[flat] = True
            r, new = flat // n, flat % n
            if not len(r):
                continue
            s = np.einsum("ij,ij->i", self.x[new], q[r])
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            rows, count = r[first], np.diff(np.r_[first, len(r)])
            place = np.arange(len(r)) - np.repeat(first, count)
            more_s = np.full((len(rows), int(count.max())), -np.inf, np.float32)
            more_i = np.full(more_s.shape, -1, np.int64)
            at = np.repeat(np.arange(len(rows)), count)
            more_s[at, place], more_i[at, place] = s, new
            all_s = np.concatenate([sims[rows], more_s], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(all_s, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more_i], axis=1), top, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], more_i < 0], axis=1), top, 1)
        return _sorted_top(sims, ids, width)

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines in single precision and places of the ``width`` nearest that a beam of that width finds for each query."""
        sims, ids = np.full((len(q), width), -np.inf, np.float32), np.full((len(q), width), -1, np.int64)
        if len(self.x):
            for at in range(0, len(q), STEP):
                part = q[at : at + STEP].astype(np.float32)
                start = np.full((len(part), 1), self.entry, np.int64)
                for level in range(self.top, 0, -1):
                    start = self._beam(part, start, 4, level)[1]
                sims[at : at + STEP], ids[at : at + STEP] = self._beam(part, start, width, 0)
        return sims, ids

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, v=self.v, ids=self.ids, **{f"t{k}": t for k, t in enumerate(self.ties)})
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        return cls(z["v"], z["ids"], [z[f"t{k}"] for k in range(len(z.files) - 2)])


def probes(graph: Graph, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors just within the threshold of random members, and the members' places: links that are known."""
    r = np.random.default_rng(13)
    place = r.integers(0, len(graph.v), PROBES)
    x = graph.v[place]
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(side, axis=1, keepdims=True)
    c = at_least + (1 - at_least) * 0.02
    q = c * x + np.sqrt(1 - c * c) * side / np.where(length > 0, length, 1)
    ok = length[:, 0] > 1e-9
    return q[ok], place[ok]


def _exact(graph: Graph, queries: np.ndarray, own: np.ndarray, at_least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Every link of every query, by products of blocks."""
    for at in range(0, len(queries), 128):
        link = (queries[at : at + 128] @ graph.v.T >= at_least) & (graph.ids[None, :] != own[at : at + 128][:, None])
        for k, row in enumerate(link):
            yield at + k, np.flatnonzero(row)


def search(graph: Graph, queries: np.ndarray, own: np.ndarray, at_least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, one at a time, the places in the graph that it links with, itself left out.

    The beam widens until an audit passes: probes made within the threshold of random members must find their
    member, and a sample of the queries, scanned in full, must find its links on average (each query that
    has some counts the same). Queries whose whole beam is within the threshold lie in a dense group and are
    scanned in full; so are all, if the widest beam fails. Links are checked in double precision.
    """
    if len(graph.v) <= BEAMS[0]:
        yield from _exact(graph, queries, own, at_least)
        return
    some = np.random.default_rng(7).permutation(len(queries))[:AUDIT]
    truth = {int(some[k]): hit for k, hit in _exact(graph, queries[some], own[some], at_least)}
    linked = [k for k in truth if len(truth[k])]
    asked, member = probes(graph, at_least)
    for width in BEAMS:
        share = [1.0]
        if len(asked):
            ids = graph.nearest(asked, width)[1]
            share.append(float((ids == member[:, None]).any(axis=1).mean()))
        if linked:
            sims, ids = graph.nearest(queries[linked], width)
            got = [np.isin(truth[k], i).mean() if s[-1] < at_least + _SLACK else 1.0 for k, s, i in zip(linked, sims, ids)]
            share.append(float(np.mean(got)))
        if min(share) >= RECALL:
            break
    else:
        yield from _exact(graph, queries, own, at_least)
        return
    for at in range(0, len(queries), 4 * STEP):
        q, mine = queries[at : at + 4 * STEP], own[at : at + 4 * STEP]
        sims, ids = graph.nearest(q, width)
        dense = np.flatnonzero(sims[:, -1] >= at_least - _SLACK)
        for k, hit in _exact(graph, q[dense], mine[dense], at_least):
            yield at + int(dense[k]), hit
        close = sims >= at_least - _SLACK
        close[dense] = False
        for k in np.flatnonzero(close.any(axis=1)):
            hit = ids[k][close[k]]
            hit = hit[(graph.v[hit] @ q[k] >= at_least) & (graph.ids[hit] != mine[k])]
            if at + k in truth:
                hit = truth[at + k]
            yield at + int(k), np.sort(hit)


def _stack(raw) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f8") for x in raw])


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", at_least: float = COSINE) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null, their lengths equal and their cosine in double
    precision at least 0.93. Vectors that are null, empty, zero or hold a null or non-finite number link
    with nothing. Vectors equal in label and numbers are one while graphs are built and searched; each
    counts as a link of the others. ``component_id`` is the smallest id reachable, the row's own included;
    rows with null ids take part, and a component of nothing but null ids has a null id. Every label is
    dealt out in shards of about SHARD_BYTES, so a hot label is many tasks; every shard is queried by
    blocks of all vectors of its label. An empty table gives an empty one; other columns don't matter.
    """
    x = F.col(vector)
    ok = F.coalesce(x.isNotNull() & F.col(label).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.when(ok, F.transform(x, lambda e: e.cast("double") + F.lit(0.0))).alias("_x"))
    # 128 bits of label and numbers stand for them
    rows = cut(rows.withColumn("_key", F.struct(F.xxhash64(F.lit(1), "_label", "_x").alias("a"), F.xxhash64(F.lit(2), "_x", "_label").alias("b"))))
    valid = rows.where("_x is not null")
    classes = valid.groupBy("_key").agg(F.count("*").alias("_copies"), F.min("_id").alias("_first"), F.first("_label").alias("_label"), F.first("_x").alias("_x"))
    classes = classes.withColumn("_cell", F.concat_ws("/", F.col("_label").cast("string"), F.size("_x").cast("string")))
    classes = cut(classes.withColumn("_node", F.monotonically_increasing_id()))
    sizes = classes.groupBy("_cell").agg(F.count("*").alias("_m"), F.max(F.size("_x")).alias("_d"))
    sizes = sizes.select("_cell", F.ceil(F.col("_m") * F.col("_d") * 8 / SHARD_BYTES).cast("int").alias("_shards"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    h = F.xxhash64("_node")

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.asarray(e, "<f8") for e in batch["_x"]]
            yield batch.drop(columns="_x").assign(_v=[(e / np.abs(e).max() / np.linalg.norm(e / np.abs(e).max())).tobytes() for e in v])

    dealt = classes.select("_node", "_cell", "_copies", "_x").join(sizes, "_cell").withColumns({"_shard": F.pmod(h, F.col("_shards")).cast("int"), "_block": F.pmod(F.xxhash64(h), F.col("_blocks")).cast("int")})
    dealt = cut(dealt.select("_node", "_cell", "_copies", "_shards", "_blocks", "_shard", "_block", "_x").mapInPandas(unit, "_node long, _cell string, _copies long, _shards int, _blocks int, _shard int, _block int, _v binary"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in runs(batches, "_unit"):
            g = g.sort_values("_node")
            graph = Graph(_stack(g["_v"]), g["_node"].to_numpy())
            yield pd.DataFrame({"_cell": [g["_cell"].iloc[0]], "_shard": [g["_shard"].iloc[0]], "_blocks": [g["_blocks"].iloc[0]], "_graph": [graph.pack()], "_n": [g["_copies"].to_numpy().astype("<i8").tobytes()]})

    name = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    graphs = dealt.withColumn("_unit", name("_cell", "_shard")).repartition("_unit").sortWithinPartitions("_unit")
    graphs = cut(graphs.select("_unit", "_node", "_cell", "_copies", "_shard", "_blocks", "_v").mapInPandas(build, "_cell string, _shard int, _blocks int, _graph binary, _n binary"))
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard"), "_cell", "_block", "_node", "_v", F.lit(None).cast("binary").alias("_n"))
    held = graphs.select("_shard", "_cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.lit(-1).cast("long").alias("_node"), F.col("_graph").alias("_v"), "_n")
    units = asked.unionByName(held).withColumn("_unit", name("_cell", "_shard", "_block")).select("_unit", "_node", "_v", "_n")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in runs(batches, "_unit"):
            index = g["_node"] < 0
            graph = Graph.unpack(g.loc[index, "_v"].iloc[0])
            copies = np.frombuffer(g.loc[index, "_n"].iloc[0], "<i8")
            g = g[~index].sort_values("_node")
            own = g["_node"].to_numpy()
            links = np.zeros(len(own), np.int64)
            # the smallest node of each place's component so far; queries are tied to that of their links
            low, of_query = graph.ids.copy(), own.copy()
            for k, hit in search(graph, _stack(g["_v"]), own, at_least):
                if not len(hit):
                    continue
                links[k] = copies[hit].sum()
                met = np.unique(low[hit])
                of_query[k] = met[0]
                if len(met) > 1:
                    low[np.isin(low, met[1:])] = met[0]
            ties = pd.DataFrame({"_node": np.r_[graph.ids, own[links > 0]], "_low": np.r_[low, of_query[links > 0]], "_links": 0})
            counts = pd.DataFrame({"_node": own, "_links": links})[links > 0].assign(_low=pd.array([None] * int((links > 0).sum()), "Int64"))
            yield pd.concat([counts, ties[ties["_node"] != ties["_low"]].astype({"_low": "Int64"})])[["_node", "_links", "_low"]]

    found = cut(units.repartition("_unit").sortWithinPartitions("_unit", "_node").mapInPandas(ask, "_node long, _links long, _low long"))
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    low = connected_components(found.select(F.col("_node").alias("a"), F.col("_low").alias("b")))
    judged = classes.select("_key", "_node", "_copies", "_first").join(links, "_node", "left").join(low.select(F.col("node").alias("_node"), "root"), "_node", "left")
    judged = cut(judged.withColumn("root", F.coalesce("root", "_node")))
    first = judged.groupBy("root").agg(F.min("_first").alias("component_id"), F.count("*").alias("_m"))
    judged = hub_join(judged, first, "root", "_m", judged.count())
    judged = judged.select("_key", "component_id", "_copies", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"))
    out = hub_join(valid.select("_id", "_key"), judged, "_key", "_copies", valid.count()).select("_id", "n_links", "component_id")
    out = out.unionByName(rows.where("_x is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(key), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
