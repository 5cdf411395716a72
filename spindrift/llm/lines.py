"""Line deduplication (operator 9): lines that stand on too large a share of their site's pages. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, cut, table, unboxed, without

#: A line on more than this share of a host's pages, and on at least so many of them, is boilerplate.
RATIO, MIN_PAGES = 0.02, 5


def line_key(line: Column) -> Column:
    """What makes two lines the same: 64 bits of the line without spaces, tabs and carriage returns around it."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(_host, _line)`` of the boilerplate lines of each host.

    A page counts once for a line however often it repeats it; both counts are combined before the
    shuffle, so a host with a third of all pages costs no more than its distinct lines.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    pages = docs.select(F.col(host).alias("_host"), F.array_distinct(F.transform(lines, line_key)).alias("_lines"))
    counts = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    totals = docs.groupBy(F.col(host).alias("_of")).agg(F.count("*").alias("_pages"))
    often = counts.where(F.col("_n") >= min_pages)
    return often.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_n") > ratio * F.col("_pages")).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``n_lines``, ``n_dropped`` (of the whole text).

    Lines end at "\\n". Blank lines are never boilerplate and stay. Null text stays null with 0 lines, an
    empty text stays empty with 1; rows with a null host form one host. Every row stays, repeated ones
    too (each is a page of its own), even when all its lines go; with ``keep_whole`` a page that would have
    no text left keeps all of it. Earlier columns named ``n_lines`` or
    ``n_dropped`` are replaced. The lines of a host number at most its mean lines a page / ratio; their
    list is broadcast only after its size is checked, else hosts are joined by a shuffle, where Spark
    splits a hot one.
    """
    found = cut(boilerplate(docs, host, text, ratio, min_pages))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    by_host = found.groupBy("_host").agg(F.collect_set("_line").alias("_drop"))
    base = boxed(docs, _of=host, _text=text)
    joined = base.join(F.broadcast(by_host) if few else by_host, F.col("_of").eqNullSafe(F.col("_host")), "left")
    lines = joined.withColumn("_all", F.split("_text", "\n"))
    kept = F.filter("_all", lambda x: ~F.array_contains("_drop", line_key(x)))
    lines = lines.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(kept))
    if keep_whole:
        left = F.exists("_kept", lambda x: F.btrim(x, F.lit(" \t\r")) != "")
        lines = lines.withColumn("_kept", F.when(left, F.col("_kept")).otherwise(F.col("_all")))
    none = F.col("_text").isNull()
    return lines.select(
        *unboxed(without(docs.columns, "n_lines", "n_dropped"), **{text: F.array_join("_kept", "\n")}),
        F.when(none, 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("_all") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP9_SQL = f"""
WITH pages AS (
  SELECT source, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS lines
  FROM documents WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(lines) AS line FROM pages) GROUP BY source, line),
totals AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.n_pages GROUP BY c.source),
split AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines, coalesce(b.lines, []) AS bad
  FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source),
kept AS (
  SELECT doc_id, source, lines, list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS left_over FROM split)
SELECT doc_id, source, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string(left_over, chr(10)), '') END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(left_over), 0) AS BIGINT) AS n_dropped
FROM kept
"""
