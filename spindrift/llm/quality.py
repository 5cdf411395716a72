"""Quality rules (operator 12): robust multivariate outliers among text statistics. DataFrame operations only.

Each text becomes a vector of transformed statistics. For each language and source a minimum-covariance-
determinant estimate (regularised, so that statistics which hardly vary don't make it singular) finds the
centre and spread of the tighter half; texts whose Mahalanobis distance from it is too large are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, boxed, checked_broadcast, cut, table, unboxed

#: Base rules: fewest words, and the largest share of words in repeated 3-word windows, in percent.
LEAST_WORDS, MOST_REPEATED, RUN = 50, 50, 3
#: The transformed statistics, in thousandths (SQL), and the spread that each has at least. Shares get a small
#: constant before the logarithm, so that long texts don't differ from short ones when a count is 0.
VECTOR = (
    ("ln(word_chars / n_words)", 100),
    ("ln(n_symbols / n_words + 0.05)", 250),
    ("ln(n_upper / word_chars + 0.02)", 250),
    ("ln(n_other / word_chars + 0.02)", 250),
    ("ln(n_repeat_words / n_words + 0.05)", 400),
    ("ln(n_dup_lines / n_lines + 0.1)", 400),
)
P = len(VECTOR)
#: Fewest texts for an estimate, concentration steps at most, share of the reweighting step, chance that a Gaussian vector is rejected.
LEAST_GROUP, STEPS, WITHIN, CHANCE = 60, 10, 0.975, 1e-6
#: Up to so many distinct repeated windows a text is scanned for each, beyond it its windows are sorted.
FEW = 64
_SPACES = " \t\n\x0b\f\r"


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


#: Covariances of the nearest half, and of those within the reweighting distance, are too small by these factors.
HALF = round(0.5 / chi2_cdf(chi2_quantile(0.5, P), P + 2), 9)
NEAR = round(chi2_quantile(WITHIN, P), 9)
MOST = round(WITHIN / chi2_cdf(NEAR, P + 2), 9)
CUTOFF = round(chi2_quantile(1 - CHANCE, P), 9)


def text_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``n_words, word_chars, n_symbols, n_upper, n_other, n_lines, n_dup_lines, n_repeat_words`` (long).

    Windows are compared by 64-bit hashes chained over their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns({"_words": F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), "_lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")})
    left = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", "")).cast("long")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(RUN)])
    none = F.array().cast("array<bigint>")
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": left("#*$%&|<>"),
            "n_upper": left("A-ZÀ-ÖØ-Þ"),
            "n_other": left("!-@\\[-`{-~"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.when(F.size("_words") >= RUN, F.transform(F.sequence(F.lit(0), F.size("_words") - RUN), window)).otherwise(none),
        }
    ).withColumn("_sorted", F.sort_array("_h"))
    rows = rows.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, j: (j > 0) & (x == F.get("_sorted", j - 1)))))
    every = F.sequence(F.lit(0), F.size("_h") - 1)
    scanned = F.filter(every, lambda i: F.array_contains("_twice", F.get("_h", i)))
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size("_twice") > FEW, placed))
    beside = lambda j, d: F.get("_placed", j + d)["h"]
    paired = F.filter("_placed", lambda x, j: ((j > 0) & (beside(j, -1) == x["h"])) | F.coalesce(beside(j, 1) == x["h"], F.lit(False)))
    starts = F.when(F.size("_twice") > FEW, F.array_sort(F.transform(paired, lambda x: x["i"]))).when(F.size("_twice") > 0, scanned).otherwise(F.array().cast("array<int>"))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-RUN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(RUN))).alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_h", "_sorted", "_twice", "_placed")


# What follows is arithmetic on columns q1, q2, ... (the vector, whole thousandths) and, per group, centre m1, ... and
# Cholesky factor l1_1, l2_1, ... It is put as SQL text, one expression for both engines.

_Q = [f"q{k}" for k in range(1, P + 1)]
_PAIRS = [(j, k) for k in range(1, P + 1) for j in range(1, k + 1)]
#: Sums of a set of vectors: whole numbers, so their order doesn't matter.
SUMS = {"n": "count(*)"} | {f"s{k}": f"sum(q{k})" for k in range(1, P + 1)} | {f"s{j}_{k}": f"sum(q{j} * q{k})" for j, k in _PAIRS}
VECTOR_SQL = {f"q{k}": f"CAST(floor(1000 * {x} + 0.5) AS BIGINT)" for k, (x, _) in enumerate(VECTOR, 1)}
#: Bins of distance: twentieths, beyond 20 whole ones; few, however many vectors a group has.
BIN = "CAST(least(floor(sqrt(d2) * 20), 400 + floor(sqrt(d2))) AS BIGINT)"
#: The first factor: scaled median absolute deviations ``w1, ...`` on the diagonal.
START_SQL = {f"l{k}_{j}": f"sqrt(1.4826 * w{k} * (1.4826 * w{k}) + {float(VECTOR[k - 1][1] ** 2)})" if j == k else "CAST(0 AS DOUBLE)" for j, k in _PAIRS}
MODEL = [f"m{k}" for k in range(1, P + 1)] + [f"l{k}_{j}" for j, k in _PAIRS]


def covariance_sql(factor: float) -> list[dict[str, str]]:
    """From sums to centre and factor, in steps of which each needs the one before."""
    c = {f"c{j}_{k}": f"{factor!r} * (CAST(s{j}_{k} AS DOUBLE) / n - m{j} * m{k})" + (f" + {float(VECTOR[k - 1][1] ** 2)}" if j == k else "") for j, k in _PAIRS}
    steps = [{f"m{k}": f"CAST(s{k} AS DOUBLE) / n" for k in range(1, P + 1)}, c]
    for j in range(1, P + 1):
        steps.append({f"l{j}_{j}": "sqrt(" + " - ".join([f"c{j}_{j}", *[f"l{j}_{i} * l{j}_{i}" for i in range(1, j)]]) + ")"})
        below = {f"l{k}_{j}": "(" + " - ".join([f"c{j}_{k}", *[f"l{k}_{i} * l{j}_{i}" for i in range(1, j)]]) + f") / l{j}_{j}" for k in range(j + 1, P + 1)}
        if below:
            steps.append(below)
    return steps


def distance_sql() -> list[dict[str, str]]:
    """From a vector and its group's centre and factor to ``d2``, the squared distance, in steps."""
    steps = [{f"y{k}": "(" + " - ".join([f"q{k}", f"m{k}", *[f"l{k}_{i} * y{i}" for i in range(1, k)]]) + f") / l{k}_{k}"} for k in range(1, P + 1)]
    return [*steps, {"d2": " + ".join(f"y{k} * y{k}" for k in range(1, P + 1))}]


def _through(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: F.expr(x) for name, x in step.items()})
    return df


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(x).alias(name) for name, x in SUMS.items()])


def _model(sums: DataFrame, factor: float) -> DataFrame:
    return cut(_through(sums, covariance_sql(factor)).select("_g", *MODEL, *SUMS))


def grouped(vectors: DataFrame, least: int = LEAST_GROUP) -> tuple[DataFrame, DataFrame]:
    """``vectors(_lang, _source, ...)`` with ``_g``, and the groups: ``_lang, _source, _g``.

    A language and source with fewer than ``least`` vectors joins its language's other small ones, a language
    whose small ones are still too few joins the other languages' ones. Null is a language or source like any other.
    """
    n = vectors.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    n = n.withColumn("_small", F.col("_n") < least)
    language = n.where("_small").groupBy("_lang").agg((F.sum("_n") < least).alias("_few")).withColumnRenamed("_lang", "_l")
    n = n.join(checked_broadcast(cut(language)), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    inside = F.when(~F.col("_small"), F.struct(F.lit(0).alias("k"), F.col("_lang").alias("l"), F.col("_source").alias("s")))
    inside = inside.when(~F.col("_few"), F.struct(F.lit(1).alias("k"), F.col("_lang").alias("l"), F.lit(None).cast("string").alias("s")))
    inside = inside.otherwise(F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s")))
    # a name that tells null from any text
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    name = F.concat(F.col("_in.k").cast("string"), part(F.col("_in.l")), F.lit(","), part(F.col("_in.s")))
    groups = cut(n.withColumn("_in", inside).select(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), name.alias("_g")))
    return with_group(vectors, groups), groups


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    same = F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))
    return rows.join(checked_broadcast(groups), same, "left").drop("_gl", "_gs")


def determinant_estimates(vectors: DataFrame, steps: int = STEPS, least: int = LEAST_GROUP) -> DataFrame:
    """``_g`` and its robust centre and factor (``MODEL``), from ``vectors(_g, q1, ...)``, which are cut from their lineage.

    Starts from medians and median absolute deviations. A concentration step bins all distances of a group, sums
    each bin, and takes the sums of the nearest bins that hold half of the group: one grouped sum, combined before
    the shuffle, of at most a few hundred rows a group. Steps end when no group's sums change. Last, the vectors
    within the ``WITHIN`` quantile are summed once more. Groups of fewer than ``least`` vectors have no estimate.
    """
    medians = [F.percentile(q, 0.5).alias(f"m{k}") for k, q in enumerate(_Q, 1)]  # whole thousandths: few distinct values
    middle = cut(vectors.groupBy("_g").agg(F.count("*").alias("_of"), *medians).where(F.col("_of") >= least))
    spread = vectors.join(checked_broadcast(middle), "_g").groupBy("_g").agg(*[F.percentile(F.expr(f"abs({q} - m{k})"), 0.5).alias(f"w{k}") for k, q in enumerate(_Q, 1)])
    hint = F.broadcast if middle.count() <= BROADCAST_ROWS else lambda small: small  # one row a group from here on
    model = cut(_through(middle.join(spread, "_g"), [START_SQL]).select("_g", *MODEL))
    half = hint(middle.select("_g", F.floor((F.col("_of") + P + 1) / 2).alias("_half")))
    upto = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    measured = lambda m: _through(vectors.join(hint(m.select("_g", *MODEL)), "_g"), distance_sql())
    before = None
    for _ in range(steps):
        binned = _summed(measured(model).withColumn("_bin", F.expr(BIN)), "_g", "_bin")
        running = binned.select("_g", "_bin", *[F.sum(c).over(upto).alias(c) for c in SUMS]).join(half, "_g").where("n >= _half")
        model = _model(running.groupBy("_g").agg(F.min_by(F.struct(*SUMS), "_bin").alias("s")).select("_g", "s.*"), HALF)
        now = model.agg(F.bit_xor(F.xxhash64("_g", *SUMS))).first()
        if now == before:
            break
        before = now
    return _model(_summed(measured(model).where(F.col("d2") <= NEAR), "_g"), MOST).select("_g", *MODEL)


BASE_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def fit(statistics: DataFrame, least: int = LEAST_GROUP) -> tuple[DataFrame, DataFrame]:
    """Groups and their estimates from ``statistics(_lang, _source, ...)``: of the texts that pass the base rules."""
    vectors = statistics.where(f"NOT ({BASE_FAILED})").select("_lang", "_source", *[F.expr(x).alias(q) for q, x in VECTOR_SQL.items()])
    inside, groups = grouped(vectors, least)
    return groups, determinant_estimates(cut(inside.select("_g", *_Q)), least=least)


def judged(statistics: DataFrame, groups: DataFrame, model: DataFrame) -> DataFrame:
    """``statistics`` with ``distance`` (Mahalanobis, null without an estimate or below the base rules), ``base_failed``, ``kept``."""
    rows = statistics.withColumn("base_failed", F.expr(BASE_FAILED))
    rows = rows.withColumns({q: F.when(~F.col("base_failed"), F.expr(x)) for q, x in VECTOR_SQL.items()})
    rows = _through(with_group(rows, groups).join(checked_broadcast(model), "_g", "left"), distance_sql())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return rows.withColumns({"distance": F.sqrt("d2"), "kept": kept})


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_GROUP) -> DataFrame:
    """``key``, the base counts, ``distance``, ``base_failed`` and ``kept`` of each row; texts are read once.

    Null, empty and blank texts have 0 of each count and fail the base rules; texts of any length are counted
    whole. Each repeated row counts and is judged, with equal results; ties in distance fall into one bin, so no
    order of rows matters. Null keys stay. Small groups are pooled (``grouped``); where even the pool has fewer
    than ``least`` texts only the base rules judge. An empty table gives an empty one. Other columns don't matter.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "_key"), (text, "_text"), (lang, "_lang"), (source, "_source"))])
    statistics = cut(text_statistics(rows, "_text").drop("_text"))
    return judged(statistics, *fit(statistics, least)).select(F.col("_key").alias(key), *COUNTS, "distance", "base_failed", "kept")


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are. Texts are read twice rather than written."""
    rows = text_statistics(boxed(docs, _text=text, _lang=lang, _source=source), "_text")
    groups, model = fit(cut(rows.drop("_row", "_text")), least)
    # the row number keeps the optimiser from moving the verdict, and with it copies of all that it is made of, below the statistics
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    return judged(rows, groups, model).where("kept AND _at >= 0").select(*unboxed(docs.columns))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql() -> str:
    listed = lambda d: ", ".join(f"{x} AS {name}" for name, x in d.items())

    def through(rows: str, steps: list[dict[str, str]]) -> str:
        for step in steps:
            rows = f"(SELECT *, {listed(step)} FROM {rows})"
        return rows

    space = r"[\x20\x09-\x0D]"
    kept = lambda c: f"CAST(length(regexp_replace(coalesce(text, ''), '[^{c}]+', '', 'g')) AS BIGINT)"
    steps, model = [], "model0"
    for k in range(1, STEPS + 1):
        steps.append(f"""
bin{k} AS (SELECT g, bin, {listed(SUMS)} FROM {through(f"(SELECT * FROM v JOIN {model} USING (g))", [*distance_sql(), {"bin": BIN}])} GROUP BY g, bin),
run{k} AS (SELECT g, bin, {", ".join(f"sum({c}) OVER (PARTITION BY g ORDER BY bin) AS {c}" for c in SUMS)} FROM bin{k}),
near{k} AS MATERIALIZED (SELECT run{k}.* FROM run{k} JOIN middle USING (g) WHERE n >= (of + {P} + 1) // 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY bin) = 1),
model{k} AS MATERIALIZED (SELECT g, {", ".join(MODEL)} FROM {through(f"near{k}", covariance_sql(HALF))}),""")
        model = f"model{k}"
    return f"""
WITH words AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, w[i:i + {RUN - 1}] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {RUN} + 2)) AS i FROM words WHERE len(w) >= {RUN})),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {RUN})) AS p FROM twice) GROUP BY doc_id),
stats AS MATERIALIZED (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {kept("#*$%&|<>")} AS n_symbols,
    {kept("A-ZÀ-ÖØ-Þ")} AS n_upper, {kept("!-@\\[-`{-~")} AS n_other, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeated r USING (doc_id)),
vec AS (SELECT doc_id, lang, source, {listed(VECTOR_SQL)} FROM stats WHERE NOT ({BASE_FAILED})),
sizes AS (SELECT lang, source, count(*) AS n FROM vec GROUP BY lang, source),
few AS (SELECT lang, sum(n) < {LEAST_GROUP} AS few FROM sizes WHERE n < {LEAST_GROUP} GROUP BY lang),
named AS (
  SELECT s.lang, s.source, CASE WHEN s.n >= {LEAST_GROUP} THEN row(0, s.lang, s.source) WHEN NOT few THEN row(1, s.lang, NULL) ELSE row(2, NULL, NULL) END AS g
  FROM sizes s LEFT JOIN few f ON s.lang IS NOT DISTINCT FROM f.lang),
v AS MATERIALIZED (SELECT vec.*, CAST(named.g AS VARCHAR) AS g FROM vec JOIN named ON vec.lang IS NOT DISTINCT FROM named.lang AND vec.source IS NOT DISTINCT FROM named.source),
middle AS MATERIALIZED (SELECT g, count(*) AS of, {", ".join(f"quantile_cont(q{k}, 0.5) AS m{k}" for k in range(1, P + 1))} FROM v GROUP BY g HAVING count(*) >= {LEAST_GROUP}),
spread AS MATERIALIZED (SELECT g, {", ".join(f"quantile_cont(abs(q{k} - m{k}), 0.5) AS w{k}" for k in range(1, P + 1))} FROM v JOIN middle USING (g) GROUP BY g),
model0 AS MATERIALIZED (SELECT g, {", ".join(f"m{k}" for k in range(1, P + 1))}, {listed(START_SQL)} FROM middle JOIN spread USING (g)),{"".join(steps)}
within AS (SELECT g, {listed(SUMS)} FROM {through(f"(SELECT * FROM v JOIN {model} USING (g))", distance_sql())} WHERE d2 <= {NEAR} GROUP BY g),
final AS MATERIALIZED (SELECT g, {", ".join(MODEL)} FROM {through("within", covariance_sql(MOST))}),
judged AS (SELECT doc_id, d2 FROM {through("(SELECT * FROM v JOIN final USING (g))", distance_sql())})
SELECT doc_id, {", ".join(COUNTS)}, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND NOT coalesce(d2 > {CUTOFF}, false) AS kept
FROM stats LEFT JOIN judged USING (doc_id)
"""


OP12_SQL = _sql()
