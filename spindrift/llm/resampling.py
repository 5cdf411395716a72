"""Target-distribution importance resampling (operator 11).

Hashed n-gram features are emitted by a ring of running CRC states: one scan over a document keeps the zlib
state of each of the last n starts, extends it by a space and the next word, and starts a new one. Buckets
that are more frequent in the target than in the corpus raise a document's weight; Gumbel noise keyed by
document turns the highest scores into a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, checked_broadcast, cut, table, unboxed

#: Longest run of words, buckets of the features, words that a drawn document has at least, percent drawn, key of the noise.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: What a model of the two distributions may hold on the driver.
MOST_BUCKETS = 1 << 20
#: In UTF-8 every byte from 0x80 on belongs to a letter beyond ASCII, so bytes can be searched instead of code points.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc_ring(words: list[bytes], run: int = RUN) -> array:
    """The CRC-32 of every run of 1 to ``run`` words joined by one space, by end of the run and then by start."""
    out, ring = array("I"), []
    for word in words:
        if len(ring) == run:
            del ring[0]
        ring = [crc32(word, crc32(b" ", state)) for state in ring]
        ring.append(crc32(word))
        out.extend(ring)
    return out


def features(docs: DataFrame, text: str, run: int, buckets: int, key: str | None = None) -> DataFrame:
    """``[_key,] _n_words, _buckets`` of each row: little-endian unsigned 32-bit buckets of its features, in one scan."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for raw in batch.column(batch.num_columns - 1).cast(pa.binary()):
                words = _WORD.findall(raw.as_py().lower()) if raw.is_valid else []  # lower() of bytes changes A-Z only
                n_words.append(len(words))
                found.append((np.frombuffer(crc_ring(words, run), np.uint32) % np.uint32(buckets)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "_n_words", "_buckets"])

    rows = docs.select(*[F.col(f"`{key}`").alias("_key")] * bool(key), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = f"_key {rows.schema[0].dataType.simpleString()}, " if key else ""
    return rows.mapInArrow(scan, f"{kind}_n_words long, _buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``rows(_buckets)``; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n += np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("_buckets").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.b] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the source."""
    t, s, k = target.astype(float), source.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, a function of seed and key alone; a null key counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``key, n_words, n_features, weight, score`` (long) of each row of ``docs``, cut from its lineage.

    Words are runs of letters and digits after lower-casing A-Z; features are all runs of 1 to ``run`` words.
    ``weight`` is the floored mean of the features' gains, 0 without features; null, empty and wordless texts
    have none. ``score`` adds the noise. Each repeated row counts and is scored; a null key has the noise of an
    empty one. Without target or without documents gains come from smoothing alone. Each text is scanned once,
    whole: its buckets are written to the shared folder, and counts and weights are read from there. Only one
    number a bucket reaches the driver.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    if run < 1:
        raise ValueError("a run has one word at least")
    found = cut(features(docs, text, run, buckets, key))
    gain = gains(bucket_counts(features(target, target_text, run, buckets), buckets), bucket_counts(found, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = [], []
            for raw in batch.column(2):
                at = np.frombuffer(raw.as_buffer(), "<u4")
                n.append(len(at))
                w.append(int(gain[at].sum()) // max(len(at), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(w, pa.int64())], names=["_key", "n_words", "n_features", "weight"])

    kind = found.schema[0].dataType.simpleString()
    out = found.mapInArrow(weigh, f"_key {kind}, n_words long, n_features long, weight long")
    out = out.withColumn("score", F.col("weight") + noise(F.col("_key"), seed))
    return cut(out.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score"))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (as ``importance`` gives it) with ``rank``: 1, 2, 3... by score for the drawn rows, else null.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: highest scores, ties
    to smaller keys (null keys last, repeated rows in any order). Rows are dealt to tasks by ranges of score,
    key and a row number, so rows with one score don't meet in a task, and a rank is a row's place in its range
    plus the sizes of the ranges before it.
    """
    able = F.col("n_words") >= least_words
    ordered = scored.where(able).withColumn("_tie", F.monotonically_increasing_id())
    ordered = cut(ordered.orderBy(F.desc("score"), F.asc_nulls_last(key), "_tie").drop("_tie"))
    at = F.monotonically_increasing_id()  # the range's number in the upper bits, the place in it in the lower 33
    numbered = ordered.withColumns({"_range": F.shiftright(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted(tuple(r) for r in numbered.groupBy("_range").count().collect())  # one row a task
    before, n = [], 0
    for k, size in sizes:
        before.append((k, n))
        n += size
    starts = F.broadcast(scored.sparkSession.createDataFrame(before, "_range long, _before long"))
    rank = F.col("_before") + F.col("_place") + 1
    drawn = numbered.join(starts, "_range").withColumn("rank", F.when(rank <= percent * n // 100, rank))
    return drawn.drop("_range", "_place", "_before").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept. ``key`` should tell rows apart: rows that share one go together."""
    drawn = draw(importance(docs, target, key, text, target_text), key, percent).where("rank is not null")
    wanted = checked_broadcast(cut(drawn.select(F.col(key).alias("_wanted")).distinct()))
    return boxed(docs, _of=key).join(wanted, F.col("_of").eqNullSafe(F.col("_wanted")), "left_semi").select(*unboxed(docs.columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = draw(importance(docs, table(spark, sf_dir, "benchmark").select("text")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: its table of 256 from the polynomial, and one step a byte.
CRC_TABLE_SQL = """
bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of ``text`` (a SQL string); the query must have ``crc`` in its FROM."""
    data = f"hex(encode({text}))"
    steps = f"list_transform(range(1, length({data}) + 1, 2), lambda i: CAST('0x' || {data}[i:i+1] AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295)"


_WORDS_SQL = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
buckets AS (SELECT w, {crc_sql('w')} % {BUCKETS} AS b FROM (SELECT w FROM d UNION SELECT w FROM b), crc),
s AS (SELECT b, count(*) AS n FROM d JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM b JOIN buckets USING (w) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM d) AS s, (SELECT count(*) FROM b) AS t),
gain AS (
  SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (total.s + {BUCKETS}) AS DOUBLE) / CAST((s.n + 1) * (total.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b), total),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM d JOIN buckets USING (w) JOIN gain USING (b) GROUP BY doc_id),
w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
