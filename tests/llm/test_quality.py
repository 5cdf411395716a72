"""Quality rules: counts against a plain version, planted outliers, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from spindrift.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def prose(r, n, words):
    return " ".join(r.choices(words, k=n)).capitalize() + "."


@pytest.mark.parametrize("few", [quality.FEW, 0])
def test_counts_equal_a_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    r = random.Random(2)
    texts = [None, "", " \t\r\n\x0b\x0c", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z w 東京 ÉTÉ", "l1\nl1\n \nl1\nl2\r\nl2", "## $$ ** | <b> 100% &amp;", "t\x00u v"]
    texts += ["a b c d " * 30_000, " ".join(f"w{k}" for k in range(60_000)) + " w1 w2 w3"]
    texts += [" ".join(r.choices("abcd", k=r.randint(1, 40))) + "\n" + "\n".join(r.choices(["x y", " x y", "z"], k=3)) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality.text_statistics(rows, "text").collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_planted_outliers_go_and_clean_texts_stay(spark):
    """Four in ten texts of one group are junk of one kind, as close to each other as prose is: the tighter half must not be pulled over."""
    r = random.Random(3)
    vocabularies = {lang: ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(400)] for lang, letters in (("en", "etaoinshrdlu"), ("fr", "éàesaitnru"))}
    rows = []
    for k in range(900):
        lang, source = ("en", "a") if k < 300 else ("fr", "a") if k < 600 else ("en", f"small{k % 90}")
        rows.append((k, prose(r, r.randint(50, 4000 if k % 50 == 0 else 300), vocabularies[lang]), lang, source, True))
    for k in range(900, 1100):
        words = r.choices(vocabularies["en"], k=r.randint(60, 300))
        rows.append((k, [" ".join(f"{w}###" for w in words), " ".join(words).upper(), " | ".join(words)][k % 2], "en", "a", False))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, clean boolean").repartition(6)
    got = {x.doc_id: x for x in quality.judge(frame).collect()}
    wrong = [(k, got[k].distance) for k, *_, clean in rows if got[k].kept != clean]
    assert not wrong
    assert all(got[k].distance is not None for k, *_ in rows)
    kept = quality.filter_quality(frame)
    assert kept.schema == frame.schema
    assert sorted(x.doc_id for x in kept.collect()) == [k for k, *_, clean in rows if clean]


def test_estimate_equals_numpy(spark):
    """The last centre and factor, from the set that they were summed over."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) * 300).astype(int)
    x[:150] += 40_000
    frame = spark.createDataFrame([("g", *map(int, v)) for v in x], "_g string, " + ", ".join(f"q{k} long" for k in range(1, 7))).repartition(3)
    m = quality.determinant_estimates(frame).first()
    centre = np.array([m[f"m{k}"] for k in range(1, 7)])
    factor = np.array([[m[f"l{k}_{j}"] if j <= k else 0 for j in range(1, 7)] for k in range(1, 7)])
    clean = x[150:]
    assert np.abs(centre - clean.mean(0)).max() < 60
    spread = np.cov(clean.T, bias=True) + np.diag([s**2 for _, s in quality.VECTOR])
    assert np.abs(np.log(np.diag(factor @ factor.T) / np.diag(spread))).max() < 0.35
    d2 = (np.linalg.solve(factor, (x - centre).T) ** 2).sum(0)
    assert (d2[:150] > quality.CUTOFF).all() and (d2[150:] < quality.CUTOFF).all()


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, kept string, _g long, n_words string, `a.b` long"
    none = spark.createDataFrame([], kind)
    assert quality.judge(none).collect() == quality.filter_quality(none).collect() == []
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(k if k % 3 else None, words, None if k % 2 else "en", None, "x", 5, "y", k) for k in range(200)] + [(None, None, None, None, None, None, None, None), (7, "", "", "", "", 0, "", 0)]
    frame = spark.createDataFrame(rows, kind)
    got = quality.judge(frame).collect()
    assert sum(x.kept for x in got) == 200 and len(got) == 202
    kept = quality.filter_quality(frame)
    assert kept.schema == frame.schema
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[:200]))
    few = quality.judge(frame.limit(20)).collect()
    assert all(x.kept and x.distance is None for x in few)


def test_null_is_not_the_text_of_a_name(spark):
    q = [1] * 6
    rows = [(lang, source, *q) for lang, source in ((None, "a"), ("-", "a"), ("en", None), ("en", "-"), ("1:a,", ""), ("", "1:a"))]
    groups = quality.grouped(spark.createDataFrame(rows, "_lang string, _source string, " + ", ".join(f"q{k} long" for k in range(1, 7))), 1)[0]
    assert groups.select("_g").distinct().count() == 6


def test_chi_square():
    from math import isclose

    assert isclose(quality.chi2_quantile(0.975, 6), 14.449375, rel_tol=1e-6)
    assert isclose(quality.chi2_quantile(0.5, 8), 7.344121, rel_tol=1e-6)


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, wanted = quality.op12_quality_rules(spark, data), con.sql(quality.OP12_SQL)
    order = sorted(got.columns)
    assert order == sorted(wanted.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(wanted.select(*order).fetchall())
