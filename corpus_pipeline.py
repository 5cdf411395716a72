"""Corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, language, lines, neardup, packing
from spindrift.llm.common import boxed, shared_dir, table, unboxed

#: A document stays if its language has at least this calibrated probability.
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; letterless and unsure ones go, null and empty texts among them.

    The model learns from rows with an id and a language. Without any label all stay. Repeated rows share their
    fate; all columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    model = language.fit_language(language.learnable(docs))
    if not model.labels:
        return docs
    judged = language.predict_language(boxed(docs, text="text"), model)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(*unboxed(docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go. A document of nothing else keeps its text: whole copies are the next stage's.

    ``n_chars``, where there is such a column, is counted anew; all other columns stay as they are. Null texts
    stay null, empty ones empty; a null source is a source; each repeated row is a page of its own.
    """
    cleaned = lines.drop_boilerplate(boxed(docs, source="source", text="text"), keep_whole=True)
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return cleaned.select(*unboxed(docs.columns, **changed))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (``neardup.keep_one``).

    Null texts and texts without words are near nothing and stay. Of rows with equal text and id one stays.
    """
    return neardup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; those without words stay, and all columns as they are."""
    judged = decontaminate.find_contamination(boxed(docs, text="text"), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*unboxed(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Trained and searched stages can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
