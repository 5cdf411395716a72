"""Stages of the pipeline: columns of any name, nulls, repeats, empty tables; sampling that repeated texts don't spoil."""

import random

import pytest

from spindrift.llm import language

pipeline = pytest.importorskip("corpus_pipeline")

OWN = "score double, lang_pred string, items string, n_words string, n_hit long, contaminated string, n_lines string, n_dropped string, _row string, _text long, _of string, _key string, _host string, `a.b` long"
KIND = f"doc_id long, text string, lang string, source string, n_chars long, {OWN}"


def prose(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))


def documents(data, spark):
    r = random.Random(11)
    item = next(x.text for x in spark.read.parquet(f"{data}/benchmark.parquet").collect() if x.text and len(x.text.split()) > 12)
    rows = []
    for k in range(120):
        lang, letters = (("aa", "abcdefghij"), ("bb", "opqrstuvwx"))[k % 2]
        text = prose(r, letters, 60) + "\nshared line of the site\n" + prose(r, letters, 20)
        rows.append((k, text if k != 40 else text + " " + item, lang, "site"))
    rows += [(200, None, "aa", "site"), (201, "", "aa", None), (202, "12 34", None, None), (None, rows[3][1], "aa", "site"), (3, rows[3][1], "aa", "site"), (3, rows[3][1], "aa", "site")]
    own = (0.25, "own", "i", "w", 7, "c", "l", "d", "r", 9, "o", "k", "h", 5)
    return rows, [(*row, len(row[1] or ""), *own) for row in rows], own


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_callers_columns(spark, data, stage):
    given, rows, own = documents(data, spark)
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    name, run = pipeline.STAGES[stage]
    out = run(spark, docs, data)
    assert out.schema == docs.schema
    got = out.collect()
    assert got and all(tuple(x)[5:] == own for x in got)
    ids = sorted(x.doc_id for x in got if x.doc_id is not None)
    if name == "language":
        assert ids == sorted([*range(120), 3, 3])
    elif name == "line_dedup":
        assert len(got) == len(rows) and not any("shared line" in (x.text or "") for x in got) and all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)
        assert sum(x.text is None for x in got) == 1
    elif name == "near_duplicates":
        assert ids.count(3) == 1 and {200, 201} <= set(ids) and len([x for x in got if x.text == given[3][1]]) == 1
    else:
        assert ids == sorted([*(k for k in range(120) if k != 40), 200, 201, 202, 3, 3])
    none = spark.createDataFrame([], KIND)
    assert run(spark, none, data).collect() == []


def test_repeated_texts_dont_thin_the_sample(spark):
    r = random.Random(5)
    texts = {y: [prose(r, letters, 12) for _ in range(400)] for y, letters in (("a", "abcdefgh"), ("b", "efghijkl"))}
    rows = [(texts["a"][0], "a")] * 5000 + [(t, y) for y, those in texts.items() for t in those[:300]]
    model = language.fit_language(spark.createDataFrame(rows, "text string, lang string"), per_label=100)
    for y, those in texts.items():
        assert sum(model.predict(t)[0] == y for t in those[300:]) >= 95, y
