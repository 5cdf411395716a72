"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows,
then calibrated by one temperature. Document frequencies are counted over all rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed, without

#: Hashed n-grams of 1 to 3 characters.
FEATURES = 1 << 15
#: The bound of the training sample: so many distinct texts of each label, about, and so many in all; a text is
#: FEATURES numbers at most.
PER_LABEL, SAMPLE = 1_500, 20_000
#: Labels learned at most, the most frequent ones (ties by name): the model has FEATURES x labels weights.
MOST_LABELS = 500
UNKNOWN = "und"
_CHUNK = 1 << 20
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (sorted) of a whole text and how often each occurs; long texts go in overlapping chunks."""
    total = np.zeros(FEATURES, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for at in range(0, len(codes), _CHUNK):
        c = codes[max(0, at - 2) : at + _CHUNK]
        new = min(at, 2)  # codes before this place were in the chunk before
        one = c * _MIX[0]
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * _MIX[1] + c[1:] * _MIX[0]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * _MIX[2] + c[2:] * _MIX[1]
        for n, h in enumerate((one, two, three)):
            h = h[max(0, new - n) :]
            total += np.bincount((h ^ (h >> np.uint32(15))) * _MIX[1] >> shift, minlength=FEATURES)
    index = np.flatnonzero(total)
    return index, total[index]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[index]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(index, counts) @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, calibrated probability); ``und`` with 0 for null, for no letter, and for an untrained model."""
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, calibrate: float = 0.2) -> Model:
    """FTRL-proximal with one accumulator for each weight; weights under the l1 bound are exactly zero.

    Every fifth row (``calibrate``) is kept out of the fit and sets the temperature, which minimises its
    log loss. Rows are taken in the given order; the result depends on nothing else.
    """
    labels = sorted({r[2] for r in rows})
    model = Model(labels, idf, np.zeros((len(idf), len(labels))), np.zeros(len(labels)))
    where = {x: k for k, x in enumerate(labels)}
    every = max(2, round(1 / calibrate))
    fit = [r for k, r in enumerate(rows) if k % every] or rows
    kept = [r for k, r in enumerate(rows) if k % every == 0]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros(len(labels)), np.zeros(len(labels))

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    xs = [(i, model.features(i, c), where[y]) for i, c, y in fit]
    for _ in range(epochs):
        for index, x, y in xs:
            zi, ni = z[index], n[index]
            w, wb = solve(zi, ni, l1), solve(zb, nb, 0.0)
            g = softmax(x @ w + wb)
            g[y] -= 1
            step = np.outer(x, g)
            z[index] = zi + step - (np.sqrt(ni + step * step) - np.sqrt(ni)) / alpha * w
            n[index] = ni + step * step
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    model.weights, model.bias = solve(z, n, l1), solve(zb, nb, 0.0)
    if kept and len(labels) > 1:
        logits = np.array([model.logits(i, c) for i, c, _ in kept])
        truth = np.array([where[y] for *_, y in kept])
        loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean()
        low, high, gold = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - gold * (high - low), low + gold * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def fit_language(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = PER_LABEL, seed: int = 7) -> Model:
    """A model from rows with a non-null label. No labelled row gives a model that always answers ``und``.

    Two scans: document frequencies of all rows (a vector of FEATURES sums, so what reaches the driver
    doesn't grow with the data), and the features of about ``per_label`` distinct texts of each label (fewer
    if there are many labels), chosen by their hashes at a rate that counts repeated texts once, and gathered in one training task. The model depends
    on the rows alone, not on their order or files. Null texts and labels teach nothing; repeated texts
    count each time in the frequencies and once in the sample; texts are read whole, however long.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("label is not null and text is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("distinct"))
    found = counts.orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    sizes, distinct = {r.label: r.n for r in found}, {r.label: r.distinct for r in found}
    per_label = min(per_label, SAMPLE // max(1, len(sizes)))
    if not sizes:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for t in batch["text"]:
                df[ngram_counts(t)[0]] += 1
        index = np.flatnonzero(df)
        yield pd.DataFrame({"feature": index.astype("int32"), "df": df[index]})

    got = rows.select("text").mapInPandas(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(FEATURES)
    df[got["feature"].to_numpy()] = got["df"].to_numpy()
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [ngram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "o": batch["o"], "i": [i.astype("<u4").tobytes() for i, _ in both], "c": [c.astype("<u4").tobytes() for _, c in both]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((o, i, c, y) for b in batches for o, i, c, y in zip(b["o"], b["i"], b["c"], b["label"])), key=lambda r: (r[0], r[3], r[1]))
        m = train([(np.frombuffer(i, "<u4"), np.frombuffer(c, "<u4"), y) for _, i, c, y in rows], idf)
        yield pd.DataFrame({"labels": [m.labels], "weights": [m.weights.astype("<f8").tobytes()], "bias": [m.bias.astype("<f8").tobytes()], "t": [m.temperature]})

    rate = F.create_map(*[x for k, v in distinct.items() for x in (F.lit(k), F.lit(min(1.0, per_label / max(1, v))))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / (1 << 30) < F.element_at(rate, F.col("label"))
    sample = rows.where(drawn).withColumn("o", F.xxhash64("text")).dropDuplicates(["label", "o"])
    out = sample.mapInPandas(features, "label string, o long, i binary, c binary").repartition(1).mapInPandas(fit, "labels array<string>, weights binary, bias binary, t double").first()
    if out is None or not out["labels"]:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    weights = np.frombuffer(out["weights"], "<f8").reshape(FEATURES, -1)
    return Model(list(out["labels"]), idf, weights, np.frombuffer(out["bias"], "<f8"), out["t"])


def predict_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone. Map-only.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows get equal answers; very long
    texts are read whole, in stretches; an empty table gives an empty one; ties go to the first label by name;
    earlier columns with these names are replaced.
    """

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    one = F.pandas_udf(predict, "lang_pred string, score double")
    out = boxed(docs, _text=text).withColumn("_p", one(F.col("_text")))
    kept = unboxed(without(docs.columns, "lang_pred", "score"))
    return out.select(*kept, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(learnable(docs))
    return predict_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
