"""N-gram Jaccard join (operator 4): a MinHash LSH forest finds candidates, exact set comparison decides.

Texts are sets of five-word shingles (lower case, words between white space; a shorter text is one shingle).
Texts with equal word sequences form a class at once; everything after works on classes, so thousands of
copies cost one signature. A class has a label of ``DEPTH`` min-hashes in each of ``TREES`` tries; the classes
below one trie node share a prefix of their labels. All tries are cut at one prefix length. It starts at full
depth and is shortened until an audit reaches the target recall: a bounded sample of texts is compared exactly
with every text in the pass that signs them, and for each link found the longest prefix shared in any trie is
known, hence the share of links that any length keeps. Classes below one node are candidates of each other.

Candidates are chained (each to the node's first class). A chained group that fits a block is compared at
once; a larger one is dealt out by shingle count (sets whose sizes differ by more than the threshold allows
can't link) and then in blocks of bounded size, and every pair that can link is compared exactly in one block
pair. No pair is ever a row: a block pair yields link counts and a spanning forest.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, checked_broadcast, connected_components, cut, gathered, hub_join, runs, table, unboxed

WORDS = 5
#: Jaccard similarity of a link, as a fraction.
LINK = (4, 5)
TREES, DEPTH = 24, 8
#: Recall that the audit must measure, and that of a pair at the threshold where the audit has no evidence.
TARGET, SURE = 0.995, 0.998
#: The audit: so many texts of at most so many characters are compared with all; so many of them must have
#: links; those with few links count as many as those with more.
AUDIT, AUDIT_LENGTH, EVIDENCE, FEW = 320, 6_000, 24, 8
#: Shingles and classes of a block, at most about; a task holds two blocks.
BLOCK_SHINGLES, BLOCK_CLASSES = 400_000, 800
#: Bytes of text hashed at once.
_CHUNK = 1 << 18
#: Shingles of a block pair compared at once.
_WIDTH = 1024
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LEAP = np.uint64(0xD1342543DE82EF95)


def normal(text: str | None) -> str:
    """The words of a text in lower case, one space between them."""
    return " ".join((text or "").lower().split())


def _bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of normal text."""
    space = np.flatnonzero(raw == 32)
    return np.r_[0, space + 1], np.r_[space, len(raw)]


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of ``raw``: polynomials in an odd number, from differences of running sums."""
    power = np.cumprod(np.full(len(raw), _LEAP), dtype=np.uint64)
    back = np.cumprod(np.full(len(raw), np.uint64(pow(int(_LEAP), -1, 1 << 64))), dtype=np.uint64)
    byte = (raw.astype(np.uint64) + np.uint64(1)) * _MULTIPLY
    byte ^= byte >> np.uint64(29)
    total = np.r_[np.uint64(0), np.cumsum(byte * power, dtype=np.uint64)]
    x = (total[ends] - total[starts]) * back[starts]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of normal text; empty if there's no word.

    Long texts are hashed in stretches of whole shingles, so memory beyond the text and the result is bounded
    (by the longest shingle).
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = _bounds(raw)
    k = min(WORDS, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    if len(raw) <= _CHUNK:
        return np.unique(_hashes(raw, starts, ends))
    parts, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        base = starts[at]
        parts.append(np.unique(_hashes(raw[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)))
        at = to
    return np.unique(np.concatenate(parts))


def meeting(depth: int, similarity: float = LINK[0] / LINK[1], trees: int = TREES) -> float:
    """The probability that a pair of that similarity shares a prefix of ``depth`` in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float = SURE, deepest: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets with probability ``recall``."""
    depth = deepest
    while depth > 1 and meeting(depth) < recall:
        depth -= 1
    return depth


class Forest:
    """Labels of the tries: 16 bits of each min-hash, by odd multipliers drawn from a fixed seed."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = r.integers(0, 1 << 32, trees * depth, dtype=np.uint32)[:, None]

    def label(self, x: np.ndarray) -> bytes:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 4096):
            part = (x[at : at + 4096] >> np.uint64(32)).astype(np.uint32)[None, :]
            low = np.minimum(low, (self.a * part + self.b).min(axis=1))
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def shared_prefix(a: bytes, b: bytes) -> int:
    """The longest prefix that two labels share in any trie."""
    same = (np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).reshape(TREES, DEPTH)
    return int(np.cumprod(same, axis=1).sum(axis=1).max())


@dataclass
class Sample:
    """The audit's texts: their classes, labels and sizes, and all their shingles with the texts that hold each."""

    classes: list[str]
    labels: list[bytes]
    sizes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Sample:
        forest, by = Forest(), {_class(t): t for t in texts if t}
        sets = [shingles(t) for t in by.values()]
        value = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        values, starts = np.unique(value[order], return_index=True)
        return cls(list(by), [forest.label(s) for s in sets], np.array([len(s) for s in sets], np.int64), values, np.r_[starts, len(value)], owner[order])

    def links(self, x: np.ndarray, own: str) -> list[int]:
        """Numbers of the sample's texts, of other classes than ``own``, that link with the set ``x``."""
        if not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        if not len(at):
            return []
        lo, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owners[place], minlength=len(self.sizes))
        found = np.flatnonzero((both > 0) & (LINK[1] * both >= LINK[0] * (self.sizes + len(x) - both)))
        return [int(q) for q in found if self.classes[q] != own]


def _class(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def audit_sample(docs: DataFrame, text: str) -> Sample:
    """The ``AUDIT`` distinct texts with the smallest hashes, of at most ``AUDIT_LENGTH`` characters."""
    t = docs.select(F.col(text).alias("_t")).where(F.length("_t") <= AUDIT_LENGTH).withColumn("_h", F.xxhash64("_t"))
    which = [r[0] for r in t.select("_h").distinct().orderBy("_h").limit(AUDIT).collect()]
    got = t.where(F.col("_h").isin(which)).dropDuplicates(["_h"]).select("_t").collect() if which else []
    return Sample.of(sorted(normal(r[0]) for r in got))


def signatures(docs: DataFrame, key: str, text: str, sample: Sample) -> DataFrame:
    """``_id, _text`` (md5), ``_class`` (md5 of the word sequence; null without words), ``_n`` shingles, ``_label``,
    ``_audit`` (texts of the sample that it links with)."""
    forest = Forest()

    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = normal(t)
            if not t:
                rows.append((None, 0, None, None))
                continue
            x, own = shingles(t), _class(t)
            rows.append((own, len(x), forest.label(x), sample.links(x, own)))
        return pd.DataFrame(rows, columns=["c", "n", "k", "q"])

    one = F.pandas_udf(sign, "c string, n long, k binary, q array<int>")
    out = docs.select(F.col(key).alias("_id"), F.md5(F.col(text).cast("binary")).alias("_text"), one(F.col(text)).alias("_s"))
    return out.select("_id", "_text", F.col("_s.c").alias("_class"), F.col("_s.n").alias("_n"), F.col("_s.k").alias("_label"), F.col("_s.q").alias("_audit"))


def measure(rows: DataFrame, sample: Sample) -> tuple[int, dict[int, float], int]:
    """The prefix length to use, the recall measured at each length, and how many sampled texts have links.

    Recall is a mean over sampled texts with links, the lower one of those with few links and those with more.
    """
    labels = sample.labels

    @F.pandas_udf("int")
    def depth(label: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([shared_prefix(bytes(a), labels[k]) for a, k in zip(label, q)], dtype="int32")

    pairs = rows.where(F.size("_audit") > 0).select("_class", "_label", F.explode("_audit").alias("q")).dropDuplicates(["_class", "q"])
    counts: dict[int, np.ndarray] = {}
    for q, d, n in pairs.select("q", depth("_label", "q").alias("d")).groupBy("q", "d").count().collect():  # at most AUDIT x DEPTH rows
        counts.setdefault(q, np.zeros(DEPTH + 1))[d] += n
    strata = [[c for c in counts.values() if few == (c.sum() <= FEW)] for few in (True, False)]
    recall = {d: min((float(np.mean([c[d:].sum() / c.sum() for c in s])) for s in strata if s), default=1.0) for d in range(DEPTH, 0, -1)}
    if len(counts) < EVIDENCE:
        return depth_for(), recall, len(counts)
    return next((d for d in recall if recall[d] >= TARGET), 1), recall, len(counts)


def candidates(classes: DataFrame, depth: int, total: int) -> DataFrame:
    """``(a, b)``: each of the ``total`` classes with the first class of every trie node at ``depth`` that holds both."""
    node = lambda t: F.xxhash64(t, F.substring("_label", t * 2 * DEPTH + 1, F.lit(2 * depth)))
    placed = classes.select("_node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), node)).alias("_key"))
    nodes = placed.groupBy("_key").agg(F.min("_node").alias("_hub"), F.count("*").alias("_m")).where("_m > 1")
    met = hub_join(placed, nodes, "_key", "_m", TREES * total, short=True)
    return met.where("_node <> _hub").select(F.col("_node").alias("a"), F.col("_hub").alias("b"))


def compare(rows: list[np.ndarray], columns: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets of ``rows`` link with which of ``columns``, as a boolean matrix; without ``columns`` with each other.

    Only shingles that occur on both sides (or twice) are compared, a bounded number of them at once.
    """
    own = columns is None
    sides = [rows] if own else [rows, columns]
    value = [np.concatenate(s) for s in sides]
    if own:
        common, times = np.unique(value[0], return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(*value)
    places = []
    for side, v in zip(sides, value):
        row = np.repeat(np.arange(len(side), dtype=np.int32), [len(x) for x in side])
        at = np.searchsorted(common, v).astype(np.int32)
        known = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == v) if len(common) else np.zeros(0, int)
        known = known[np.argsort(at[known], kind="stable")]
        places.append((row[known], at[known], len(side)))
    both = np.zeros((len(rows), len(sides[-1])), np.int32)
    for lo in range(0, len(common), _WIDTH):
        x = []
        for row, at, n in places:
            here = slice(*np.searchsorted(at, (lo, lo + _WIDTH)))
            part = np.zeros((n, min(_WIDTH, len(common) - lo)), np.float32)
            part[row[here], at[here] - lo] = 1
            x.append(part)
        both += (x[0] @ x[-1].T).astype(np.int32)
    size = [np.array([len(x) for x in s], np.int64) for s in sides]
    link = (LINK[0] + LINK[1]) * both.astype(np.int64) >= LINK[0] * (size[0][:, None] + size[-1][None, :])
    if own:
        np.fill_diagonal(link, False)
    return link


def lowest(link: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest of its component, where ``link`` joins nodes ``rows`` with nodes ``columns``."""
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        new[columns] = np.minimum(new[columns], np.where(link, new[rows][:, None], n).min(axis=0))
        new[rows] = np.minimum(new[rows], np.where(link, new[columns][None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def dealt_out(inside: DataFrame, total: int) -> DataFrame:
    """``inside(_root, _node, _n, ...)`` with ``_place`` (the class's block) and ``_units`` (block pairs to go to).

    A group within the limits of one block is one unit. Of a larger one, each stretch of shingle counts (as
    long as linked sets can differ) is cut into blocks; a block meets those of its own stretch and of the next.
    """
    stretch = F.floor(F.log(F.col("_n").cast("double")) / F.log(F.lit(LINK[1] / LINK[0] + 1e-7))).cast("long")
    inside = inside.withColumn("_cell", F.struct("_root", stretch.alias("g")))
    cells = gathered(inside.groupBy("_cell").agg(F.count("*").alias("_m"), F.sum("_n").alias("_s")), total)
    group = Window.partitionBy("_cell._root")
    order = group.orderBy("_cell.g")
    blocks = lambda m, s: F.greatest(F.ceil(s / BLOCK_SHINGLES), F.ceil(m / BLOCK_CLASSES)).cast("int")
    cells = cells.withColumns({"_own": blocks(F.col("_m"), F.col("_s")), "_whole": blocks(F.sum("_m").over(group), F.sum("_s").over(group)) == 1})
    near = lambda f, step: F.when(f("_cell.g").over(order) == F.col("_cell.g") + step, f("_own").over(order)).otherwise(0)
    cells = gathered(cells.withColumns({"_below": near(F.lag, -1), "_above": near(F.lead, 1)}).drop("_s"), total)
    out = hub_join(inside, cells, "_cell", "_m", total, short=True)
    out = out.withColumn("_b", F.pmod(F.xxhash64("_node"), F.col("_own")).cast("int"))
    root, g, b = F.col("_cell._root"), F.col("_cell.g"), F.col("_b")
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<string>"))
    own = upto("_own", lambda o: F.format_string("%d/%d:%d/%d:%d", root, g, F.least(b, o), g, F.greatest(b, o)))
    below = upto("_below", lambda o: F.format_string("%d/%d:%d/%d:%d", root, g - 1, o, g, b))
    above = upto("_above", lambda o: F.format_string("%d/%d:%d/%d:%d", root, g, b, g + 1, o))
    units = F.when(F.col("_whole"), F.array(F.format_string("%d/0/0", root))).otherwise(F.concat(own, below, above))
    return out.select("_node", "_copies", "_id", "_text", F.col("_whole"), F.format_string("%d:%d", g, b).alias("_place"), units.alias("_units"))


def verify(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """``_node, _links, _low, _multi``: per unit the copies linked to each class and its component's first class.

    Only texts of members are fetched, one for each class; they travel as arrays of shingles.
    """

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(normal(t)).tobytes() for t in texts], dtype="object")

    texts = docs.select(F.col(key).alias("_id2"), F.md5(F.col(text).cast("binary")).alias("_text2"), F.col(text).alias("_t"))
    got = texts.join(checked_broadcast(members), (F.col("_text2") == F.col("_text")) & F.col("_id2").eqNullSafe(F.col("_id")))
    got = got.select("_node", "_copies", "_whole", "_place", "_units", packed("_t").alias("_x"))
    dealt = got.select("_node", "_copies", "_whole", "_place", "_x", F.explode("_units").alias("_unit"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        held = 0
        for unit, group in runs(batches, "_unit"):
            group = group.drop_duplicates("_node").sort_values("_node")
            _, i, j = unit.rsplit("/", 2)
            place, sets = group["_place"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["_x"]]
            a, b = (np.arange(len(sets)),) * 2 if i == j else (np.flatnonzero(place == i), np.flatnonzero(place == j))
            if len(a) and len(b) and len(sets) > 1:
                link = compare([sets[k] for k in a], None if i == j else [sets[k] for k in b])
                node, copies = group["_node"].to_numpy(), group["_copies"].to_numpy()
                links = np.zeros(len(sets), np.int64)
                links[a] += np.where(link, copies[b][None, :], 0).sum(axis=1)
                if i != j:
                    links[b] += np.where(link, copies[a][:, None], 0).sum(axis=0)
                found = pd.DataFrame({"_node": node, "_links": links, "_low": node[lowest(link, a, b, len(sets))], "_multi": ~group["_whole"].to_numpy(bool)})
                out.append(found[links > 0])
                held += len(out[-1])
            if held > 10_000:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    dealt = dealt.repartition("_unit").sortWithinPartitions("_unit")
    return dealt.mapInPandas(work, "_node long, _links long, _low long, _multi boolean")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, _text`` (md5), ``class_id``, ``n_links``, ``kept``.

    ``n_links``: other rows whose shingle sets have Jaccard similarity 0.8 or more (copies count one by
    one). ``class_id``: the smallest id reachable by links, the row's own included. ``kept``: the row has
    that id. Null texts and texts without words link with nothing and keep themselves; rows with a null id
    are compared like others, and a class of nothing but null ids has a null class id. Repeated rows link
    with each other and, sharing an id, are kept or dropped together. Texts are taken whole, however long.
    An empty table gives an empty one; other columns don't matter, whatever their names.
    """
    return judge(docs, key, text).drop("_node")


def judge(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``near_duplicates`` with ``_node``, the first class of the row's component; null without words."""
    sample = audit_sample(docs, text)
    rows = cut(signatures(docs, key, text, sample))
    rows = gathered(rows, rows.count())
    depth, recall, evidence = measure(rows, sample)
    logging.getLogger(__name__).info("prefixes of %d of %d; recall by length %s from %d texts", depth, DEPTH, recall, evidence)
    classes = rows.where("_class is not null").groupBy("_class").agg(
        F.count("*").alias("_copies"), F.min("_id").alias("_first"), F.min(F.struct("_text", "_id")).alias("_one"), F.first("_label").alias("_label"), F.first("_n").alias("_n")
    )
    classes = cut(classes.withColumn("_node", F.monotonically_increasing_id()))
    total, worded = classes.agg(F.count("*"), F.coalesce(F.sum("_copies"), F.lit(0))).first()
    classes = gathered(classes, TREES * total)  # each makes a row a trie
    groups = connected_components(candidates(classes, depth, total)).withColumnRenamed("node", "_node").withColumnRenamed("root", "_root")
    light = classes.select("_node", "_copies", "_n", F.col("_one._text").alias("_text"), F.col("_one._id").alias("_id"))
    members = cut(dealt_out(gathered(light.join(groups, "_node"), total), total))
    found = cut(verify(docs, members, key, text))
    found = gathered(found, found.count())
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    alone = gathered(found.where("not _multi").groupBy("_node").agg(F.min("_low").alias("_low")), total)
    across = connected_components(found.where("_multi").select(F.col("_node").alias("a"), F.col("_low").alias("b")))
    low = alone.unionByName(across.select(F.col("node").alias("_node"), F.col("root").alias("_low")))
    judged = classes.select("_class", "_node", "_copies", "_first").join(links, "_node", "left").join(low, "_node", "left")
    judged = cut(gathered(judged.withColumn("_low", F.coalesce("_low", "_node")), total))
    first = judged.groupBy("_low").agg(F.min("_first").alias("class_id"), F.count("*").alias("_m"))
    judged = hub_join(judged, first, "_low", "_m", total, short=True).select("_class", "_low", "class_id", "_copies", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    judged = hub_join(rows.where("_class is not null").select("_id", "_text", "_class"), judged, "_class", "_copies", worded, short=True)
    wordless = rows.where("_class is null").select("_class", "_id", "_text", F.lit(None).cast("long").alias("_low"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = judged.unionByName(wordless)
    return out.select(F.col("_id").alias(key), "_text", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("_low").alias("_node"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id (null ids last), then
    the smallest text hash, once.

    Rows without words all stay. Texts aren't shuffled while the lists of rows to drop are short.
    """
    judged = judge(docs, key, text).where("_node is not null").select("_node", F.col(key).alias("_id2"), F.col("_text").alias("_text2"))
    # a text is in one component, so id and text tell which rows are the one that stays
    distinct = cut(judged.groupBy("_node", "_id2", "_text2").count())
    total = distinct.count()
    distinct = gathered(distinct, total)
    place = F.struct(F.col("_id2").isNull().alias("a"), F.col("_id2").alias("b"), F.col("_text2").alias("c"))
    first = cut(gathered(distinct.groupBy("_node").agg(F.min(place).alias("_first"), F.sum("count").alias("_n")).where("_n > 1").drop("_n"), total))
    ranked = cut(distinct.join(checked_broadcast(first), "_node").select("_id2", "_text2", "count", (place == F.col("_first")).alias("_stays")))
    same = F.col("_id2").eqNullSafe(F.col("_key")) & (F.col("_text2") == F.md5(F.col("_whole").cast("binary")))
    gone = ranked.where("not _stays").select("_id2", "_text2")
    many = ranked.where("_stays and count > 1").select("_id2", "_text2")
    out = boxed(docs, _key=key, _whole=text).join(checked_broadcast(gone), same, "left_anti")
    if not many.isEmpty():
        once = out.join(checked_broadcast(many), same, "left_semi").dropDuplicates(["_key", "_whole"])
        out = out.join(checked_broadcast(many), same, "left_anti").unionByName(once)
    return out.select(*unboxed(docs.columns))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept")
