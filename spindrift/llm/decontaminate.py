"""Benchmark decontamination (operator 10) by winnowing. DataFrame operations only.

Fingerprints are 64-bit hashes of 5 words; of every 6 in a row (10 words) the smallest is kept. Two texts
that share 10 words in a row keep the same one there, so joining kept fingerprints misses no shared span of
that length. A match is then extended: each 10-word window of the document that kept the fingerprint is
compared word by word with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, checked_broadcast, cut, table, unboxed, without

# What separates words (before lower-casing), and the window.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
_SPAN = WINDOW - GRAM + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _positions(n: Column, last: int, f) -> Column:
    """``f(i)`` for i from 0 while ``i + last < n``; an empty array if there's none."""
    return F.when(n > last, F.transform(F.sequence(F.lit(0), n - last - 1), f)).otherwise(F.array().cast("array<bigint>"))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df(_words)`` with ``_n``, ``_min`` (per 10-word window its fingerprint) and, per short length, ``_s<length>``.

    Words are hashed after full lower-casing of each, which never separates words that are equal after
    lower-casing A-Z; false matches fall to the exact comparison.
    """
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(F.lower(w)))).withColumn("_n", F.size("_words"))
    gram = lambda k, *more: lambda i: F.xxhash64(*more, *[F.get("_h", i + j) for j in range(k)])
    df = df.withColumns({"_g": _positions(F.col("_n"), GRAM - 1, gram(GRAM)), **{f"_s{k}": _positions(F.col("_n"), k - 1, gram(k, F.lit(k))) for k in lengths}})
    return df.withColumn("_min", _positions(F.size("_g"), _SPAN - 1, lambda i: F.least(*[F.get("_g", i + j) for j in range(_SPAN)]))).drop("_g", "_h")


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """The windows of all items: ``_size, _text`` (words joined by spaces), ``_fp``, ``_item``."""
    words = words_of(F.translate(F.col(text), _UPPER, _LOWER))
    b = benchmark.select(F.col(item).cast("string").alias("_item"), words.alias("_words")).where(F.size("_words") > 0)
    b = _windows(b, list(range(1, WINDOW)))
    starts = F.sequence(F.lit(0), F.greatest(F.col("_n") - WINDOW, F.lit(0)))
    b = b.select("*", F.explode(starts).alias("_i"))
    size = F.least(F.col("_n"), F.lit(WINDOW))
    fp = F.when(F.col("_n") >= WINDOW, F.get("_min", F.col("_i")))
    for k in range(1, WINDOW):
        fp = fp.when(F.col("_n") == k, F.get(f"_s{k}", F.lit(0)))
    return b.select("_item", size.alias("_size"), F.array_join(F.slice("_words", F.col("_i") + 1, size), " ").alias("_text"), fp.alias("_fp")).distinct()


def hits_by_text(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> DataFrame:
    """``_key`` (md5 of the text), ``n_hit``, ``items`` for each distinct text that holds an item's window."""
    held = cut(item_windows(benchmark, item, item_text))
    windows = cut(held.select("_size", "_text", "_fp").distinct().withColumn("_w", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in windows.where(F.col("_size") < WINDOW).select("_size").distinct().collect())  # nine at most
    base = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("_key"), F.col(text).alias("_t"))
    prints = _windows(base.select("_key", words_of(F.col("_t")).alias("_words")), short)
    every = F.array_distinct(F.concat("_min", *[F.col(f"_s{k}") for k in short]))
    wanted = checked_broadcast(cut(windows.select("_fp").distinct()), 2_000_000)
    met = prints.select("_key", F.explode(every).alias("_fp")).join(wanted, "_fp").groupBy("_key").agg(F.collect_set("_fp").alias("_fps"))
    near = checked_broadcast(cut(met))
    again = base.join(near, "_key").dropDuplicates(["_key"]).select("_key", "_fps", words_of(F.translate("_t", _UPPER, _LOWER)).alias("_words"))
    again = _windows(again, short)

    def matched(column: str, size: int) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(column) - 1), lambda i: F.array_contains("_fps", F.get(column, i)))
        at = F.when(F.size(column) > 0, at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size")))

    spots = F.concat(matched("_min", WINDOW), *[matched(f"_s{k}", k) for k in short])
    spots = again.select("_key", "_words", F.explode(spots).alias("_s"))
    spots = spots.select("_key", F.col("_s.at").alias("_at"), F.col("_s.size").alias("_size"), F.array_join(F.slice("_words", F.col("_s.at") + 1, F.col("_s.size")), " ").alias("_text"))
    hits = cut(spots.join(checked_broadcast(windows.drop("_fp")), ["_size", "_text"]).select("_key", "_at", "_size", "_w"))
    whole = hits.groupBy("_key").agg(F.collect_set(F.struct("_at", "_size")).alias("_spots"))
    covered = F.array_distinct(F.flatten(F.transform("_spots", lambda s: F.sequence(s["_at"], s["_at"] + s["_size"] - 1))))
    # items are looked up by window once texts are distinct, so a window that very many items share isn't multiplied by its hits
    holders = cut(held.join(windows, ["_size", "_text", "_fp"]).select("_w", "_item"))
    items = hits.select("_key", "_w").distinct().join(checked_broadcast(holders), "_w").groupBy("_key").agg(F.sort_array(F.collect_set("_item")).alias("items"))
    return whole.select("_key", F.size(covered).cast("long").alias("n_hit")).join(items, "_key", "left")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted) and ``contaminated``.

    A window is 10 words of an item in a row, or all words of a shorter item; a word of a document inside
    any occurrence of a window is hit. Null and wordless texts have no words and aren't contaminated; null
    or wordless items match nothing; an item with a null id hits words but isn't listed. Rows are judged by
    their text, so repeated rows get equal results; copies are fingerprinted each and extended once. Empty
    tables on either side are fine; texts are searched whole, however long. Earlier columns with these names
    are replaced. Nothing is broadcast unchecked: small lists of fingerprints, matched texts and windows are,
    larger ones shuffle.
    """
    base = boxed(docs, _text=text)
    hits = checked_broadcast(cut(hits_by_text(docs, benchmark, text, item, item_text)))
    out = base.withColumn("_of", F.md5(F.col("_text").cast("binary"))).join(hits, F.col("_of") == F.col("_key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *unboxed(without(docs.columns, "n_words", "n_hit", "items", "contaminated")),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(words_of(F.col("_text")))).cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT item_id, least(len(w), {WINDOW}) AS k, w[i:i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, i, k, w[i:i + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
hits AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
