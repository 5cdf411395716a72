"""Importance resampling against a plain version."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from spindrift.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, run):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, run, buckets, percent, least):
    s, t = Counter(), Counter()
    for text in target:
        t.update(h % buckets for h in grams(text, run)[1])
    for _, text in docs:
        s.update(h % buckets for h in grams(text, run)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (total_s + buckets)) / float((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, text in docs:
        n, found = grams(text, run)
        w = sum(gain(h % buckets) for h in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=repr)


TEXTS = ["", None, "?!", "The quick brown fox " * 9, "ÉTÉ été Été 7 " * 8, "a b c " * 20, "straße über 東京 x9 " * 30, "one two", "w" * 50_000, "to be or not " * 5_000]


@pytest.mark.parametrize("run", [1, 3])
def test_equals_a_plain_version(spark, run):
    docs = [(k, f"{TEXTS[k % 10]} {k % 7} z{k % 11}" if TEXTS[k % 10] and k % 3 else TEXTS[k % 10]) for k in range(200)]
    docs += [(5, TEXTS[5])] * 30 + [(None, TEXTS[3])] * 3
    target = ["the fox of the target", None, "", "été à tokyo 東京"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    scored = resampling.importance(frame, spark.createDataFrame([(t,) for t in target], "text string"), run=run, buckets=97)
    got = resampling.draw(scored, percent=40).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, target, run, 97, 40, 20)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, "word " * 30, 1.5, "x", k) for k in range(20)], "doc_id long, text string, score double, _key string, `a.b` long")
    for docs, target in ((none, none), (none, some), (some, none)):
        got = resampling.draw(resampling.importance(docs, target))
        assert got.count() == docs.count()
        assert got.where("rank is not null").count() == docs.count() // 10
    kept = resampling.resample(some, none, percent=50)
    assert kept.schema == some.schema
    assert kept.count() == 10
    assert kept.where("score = 1.5 and _key = 'x' and `a.b` = doc_id").count() == 10


def test_ring_extends_each_start():
    assert list(resampling.crc_ring([b"a", b"bc", b"d"], 2)) == [crc32(x) for x in (b"a", b"a bc", b"bc", b"bc d", b"d")]
    assert list(resampling.crc_ring([], 2)) == []


@pytest.mark.parametrize("wrong", [{"buckets": 0}, {"buckets": 1 << 21}, {"run": 0}])
def test_arguments(spark, wrong):
    with pytest.raises(ValueError):
        resampling.importance(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string"), **wrong)
