"""The file catalog: entities parsed from paths, and the selections that loaders need, as queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = ("sub", "ses", "task", "run", "echo", "space", "desc")
# Repetition times in seconds, and the names of the event tasks of a session's runs.
REPETITION = {"rest": 1.0, "nsdimagery": 1.333, "pinel": 1.5, "simon": 1.5, "motor": 1.5, "breathhold": 1.5}
RUN_LETTERS = {"02": "attA", "05": "attB", "08": "attC"}


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path`` of every file below a folder, by Spark's own listing (any file system it reads)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path")


def entity(path: Column, name: str) -> Column:
    """The value of ``name-<value>`` in the file name, null if there's none. Leading zeros stay."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return F.nullif(F.regexp_extract(base, f"(?:^|_){name}-([^_.]+)", 1), F.lit(""))


def parse(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Entities, suffix and extension of each path, and the listing's own columns ``keep``."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(
        *keep, "path", *[entity(F.col("path"), e).alias(e) for e in ENTITIES],
        F.regexp_extract(base, r"_([A-Za-z0-9]+)\.[^_]*$", 1).alias("suffix"), F.regexp_extract(base, r"(\..*)$", 1).alias("extension"),
    )


def parse_fixed(files: DataFrame) -> DataFrame:
    """``<subject>_task-<task>_session<NN>_run<NN>.nii.gz``; another name is an error."""
    pattern = r"([^/_]+)_task-([^_/]+)_session(\d+)_run(\d+)\.nii\.gz$"
    ok = F.assert_true(F.col("path").rlike(pattern), F.concat(F.lit("unexpected name "), F.col("path")))
    part = lambda k: F.when(ok.isNull(), F.regexp_extract("path", pattern, k))
    return files.select("path", part(1).alias("sub"), part(2).alias("task"), part(3).alias("ses"), part(4).alias("run"))


def runs_of(files: DataFrame) -> DataFrame:
    """``task, ses`` with the sorted list of runs."""
    return files.where("run is not null").groupBy("task", "ses").agg(F.sort_array(F.collect_set("run")).alias("runs"))


def select(files: DataFrame, **wanted: str | Sequence[str] | None) -> DataFrame:
    """Rows whose entities have the given values (one, or any of several); None matches everything."""
    for name, v in wanted.items():
        if v is not None:
            files = files.where(F.col(name).isin(list(v) if not isinstance(v, str) else [v]))
    return files


def sessions_with(files: DataFrame, task: str) -> DataFrame:
    return select(files, task=task).select("ses").distinct().orderBy("ses")


def subjects(files: DataFrame) -> DataFrame:
    return files.select("sub").distinct().orderBy("sub")


def one_each(files: DataFrame, by: Sequence[str], what: str = "file", expected: int = 1) -> DataFrame:
    """``by`` with the paths of each group in order; a group of another size than ``expected`` is an error."""
    got = files.groupBy(*by).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    ok = F.assert_true(F.size("paths") == expected, F.concat(F.lit(f"expected {expected} {what}, found "), F.size("paths").cast("string")))
    return got.withColumn("paths", F.when(ok.isNull(), F.col("paths")))


def echo_sets(files: DataFrame, n_echoes: int, keys: Sequence[str] = ("sub", "ses", "task", "run")) -> DataFrame:
    """Per run its echo files in order, ``n_echoes`` of them or an error."""
    got = files.where("echo is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("echo").cast("int").alias("e"), "path"))).alias("_e"))
    ok = F.assert_true(F.size("_e") == n_echoes, F.lit("wrong number of echoes"))
    return got.select(*keys, F.when(ok.isNull(), F.transform("_e", lambda s: s["path"])).alias("paths"))


def functional(files: DataFrame, task: str, desc: str | None, extension: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """Functional files of a stage; single echoes never count."""
    got = select(files, task=task, ses=sessions, suffix="bold", extension=extension).where("echo is null")
    return got.where(F.col("desc").eqNullSafe(F.lit(desc)))


def functional_stage(files: DataFrame, task: str, stage: str = "orig", kind: str = "volume", series: str = "optcomb", sessions: Sequence[str] | None = None) -> DataFrame:
    """Functional files by stage (``orig`` or ``final``), ``volume`` or ``surface``, and the combined series or the ``t2`` or ``s0`` maps."""
    # Descriptions by kind and stage, and extensions.
    desc = {("volume", "orig"): "preproc", ("volume", "final"): "preprocfinal", ("surface", "orig"): None, ("surface", "final"): "preprocfinal"}
    extension = {"volume": ".nii.gz", "surface": ".dtseries.nii"}
    if (kind, stage) not in desc or series not in ("optcomb", "t2", "s0"):
        raise ValueError(f"no functional files of {kind}, {stage}, {series}")
    known_sessions(files, sessions)
    name = desc[kind, stage] if series == "optcomb" else (desc[kind, stage] or "") + series
    return functional(files, task, name, extension[kind], sessions)


def physio_stage(files: DataFrame, task: str, stage: str = "orig", sessions: Sequence[str] | None = None) -> DataFrame:
    """Recordings by stage: as they were taken (no description), or ``final`` ones (``desc-preproc``)."""
    if stage not in ("orig", "final"):
        raise ValueError("stage must be orig or final")
    known_sessions(files, sessions)
    got = select(files, task=task, ses=sessions, suffix="physio", extension=".tsv.gz")
    return got.where(F.col("desc").eqNullSafe(F.lit("preproc" if stage == "final" else None)))


def known_sessions(files: DataFrame, sessions: Sequence[str] | None) -> None:
    """An error for a session that no file has. Only sessions that are asked for reach the driver."""
    if sessions is not None:
        there = {r[0] for r in files.where(F.col("ses").isin(list(sessions))).select("ses").distinct().collect()}
        if missing := sorted(set(sessions) - there):
            raise ValueError(f"no session {missing}")


def single_echoes(files: DataFrame) -> DataFrame:
    """Files of a data set with one echo in the form of ``echo_sets``: each is the only one of its list."""
    return files.withColumn("paths", F.array("path"))


def transforms(runs: DataFrame, files: DataFrame, space: str) -> DataFrame:
    """``runs(sub, ses, task, run)`` with ``reference``, ``to_anatomy`` and ``to_space``: one file each or an error.

    The reference and the first transform are the run's own, the second is the subject's. A null run (or
    session) of ``runs`` is met by null only.
    """
    keys = ["sub", "ses", "task", "run"]
    f = files.withColumns({"to": entity(F.col("path"), "to"), "mode": entity(F.col("path"), "mode")}).where(F.col("mode").isNull() | (F.col("mode") == "image"))
    kinds = {
        "reference": (keys, (F.col("suffix") == "boldref") & (F.col("space") == space)),
        "to_anatomy": (keys, (F.col("to") == "T1w") & F.col("mode").isNotNull() & (F.col("desc") == "coreg") & (F.col("extension") == ".txt")),
        "to_space": (["sub"], (F.col("to") == space) & F.col("mode").isNotNull()),
    }
    out = runs
    for name, (by, which) in kinds.items():
        one = f.where(which).groupBy(*by).agg(F.collect_list("path").alias("_p")).select(*[F.col(k).alias(f"_{k}") for k in by], "_p")
        joined = out.join(one, reduce(and_, [out[k].eqNullSafe(F.col(f"_{k}")) for k in by]), "left")
        n = F.coalesce(F.size("_p"), F.lit(0))
        ok = F.assert_true(n == 1, F.concat(F.lit(f"expected 1 file for {name}, found "), n.cast("string")))
        out = joined.select(*[out[c] for c in out.columns], F.when(ok.isNull(), F.get("_p", F.lit(0))).alias(name))
    return out


def match_runs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sub", "ses", "task", "run")) -> DataFrame:
    """Files of one kind with the other kind's file of the same run.

    Runs without a match are left out; several matches are an error. A key that is null on the right matches any.
    Files with all keys are joined by all of them; only the others are joined by the first key and filtered.
    """
    r = right.groupBy(*keys).agg(F.collect_list("path").alias("_p"))
    ok = F.assert_true(F.size("_p") == 1, F.lit("several files match one run"))
    r = r.select(*[F.col(k).alias(f"_{k}") for k in keys], F.when(ok.isNull(), F.get("_p", F.lit(0))).alias("matched"))
    always = [k for k in keys if k == "sub"] or list(keys[:1])
    cond = [left[k] == F.col(f"_{k}") for k in always] + [F.col(f"_{k}").isNull() | (left[k] == F.col(f"_{k}")) for k in keys if k not in always]
    every = [F.col(f"_{k}").isNotNull() for k in keys]
    known = reduce(and_, every)
    exact = left.join(r.where(known), reduce(and_, [left[k] == F.col(f"_{k}") for k in keys])).select(left["*"], "matched")
    loose = left.join(r.where(~known), reduce(and_, cond)).select(left["*"], "matched")
    return exact.unionByName(loose)


def unmatched_runs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sub", "ses", "task", "run")) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def timing_pairs(files: DataFrame) -> DataFrame:
    """Onset files with the duration file of the same condition, run by key; either missing is an error."""
    keys = ("sub", "ses", "task", "condition")
    condition = F.regexp_extract("path", r"_([A-Za-z]+)_(onset|duration)[^/]*$", 1)
    kind = F.regexp_extract("path", r"_(onset|duration)[^/]*$", 1)
    f = files.withColumns({"condition": condition, "kind": kind}).where("kind <> ''")
    pairs = f.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "onset", F.col("path"))).alias("onset_path"), F.max(F.when(F.col("kind") == "duration", F.col("path"))).alias("duration_path"), F.count("*").alias("_n"))
    ok = F.assert_true((F.col("_n") == 2) & F.col("onset_path").isNotNull() & F.col("duration_path").isNotNull(), F.lit("no pair of timing files"))
    return pairs.withColumn("onset_path", F.when(ok.isNull(), F.col("onset_path"))).drop("_n")


def condition_file(files: DataFrame, condition: str) -> DataFrame:
    """The one file whose path holds ``condition``; none or several is an error."""
    met = files.where(F.contains("path", F.lit(condition)))
    n = met.agg(F.count("*").alias("n"), F.min("path").alias("path"))
    ok = F.assert_true(F.col("n") == 1, F.format_string("%d files for condition " + condition.replace("%", "%%"), F.col("n")))
    return n.select(F.when(ok.isNull(), F.col("path")).alias("path"))


def repetition_time(task: Column, times: dict[str, float] = REPETITION) -> Column:
    """Seconds a volume takes; an unknown task is an error."""
    table = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])
    tr = F.try_element_at(table, task)
    return F.coalesce(tr, F.raise_error(F.concat(F.lit("unknown task "), task)).cast("double"))


def run_letter(run: Column) -> Column:
    """The letter of a run; other runs are an error."""
    letter = F.try_element_at(F.create_map(*[F.lit(x) for kv in RUN_LETTERS.items() for x in kv]), run)
    return F.coalesce(letter, F.raise_error(F.concat(F.lit("run without events: "), run)).cast("string"))


def fixed_name(sub: Column, task: Column, ses: Column, run: Column, ending: str = ".nii.gz") -> Column:
    return F.format_string(f"%s_task-%s_session%s_run%s{ending}", sub, task, ses, run)


def existing(names: DataFrame, files: DataFrame) -> DataFrame:
    """Constructed paths that are there."""
    return names.join(files.select("path").distinct(), "path", "left_semi")
