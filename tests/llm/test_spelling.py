"""Spelling variants against a plain version."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from spindrift.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    found = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain(counts):
    rows = []
    forms = {}
    for w, n in counts.items():
        those = sorted((-m, v) for v, m in counts.items() if near(w, v))
        forms[w] = (those[0][1], -those[0][0], len(those)) if those and -those[0][0] >= 2 * n else (None, None, len(those))
    for w, n in counts.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        rows.append((w, forms[w][0], root, n, forms[w][2], forms[w][1]))
    return sorted(rows)


def corpus(times):
    r = random.Random(4)
    base = ["spelling", "straße", "élèves", "grouping", "aaaaaaab", "banana", "anagram"] + ["".join(r.choices("abcé", k=r.randint(4, 8))) for _ in range(60)]
    docs = [(None, "Null Key key keys"), (1, None), (2, ""), (3, "12 34 !"), (4, "longword" * times + " " + "longword" * times + "s"), (4, "longword" * times + " spelling"), (4, "longword" * times)]
    for k in range(300):
        words = []
        for w in r.choices(base, weights=[1 / (j + 1) for j in range(len(base))], k=40):
            if r.random() < 0.2:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcé×Ÿ") + w[i + 1 :], w[:i] + "x" + w[i:]])
            words.append(w.upper() if r.random() < 0.2 else w)
        docs.append((k % 250, " ".join(words)))
    return docs


@pytest.mark.parametrize("crowd, times", [(200, 20_000), (0, 20)])
def test_equals_a_plain_version(spark, crowd, times):
    docs = corpus(times)
    counts = plain_counts(docs)
    words = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r.word: r.n for r in words.collect()} == counts
    got = spelling.spelling_variants(words, crowd=crowd).collect()
    assert sorted(tuple(r) for r in got) == plain(counts)
    assert sum(r[1] is not None for r in got) > 50 and any(r.root != r.form for r in got if r.form)


def test_many_orders_of_the_same_letters(spark):
    """Keys shared by thousands of offers are joined by order too: pairs stay in proportion to words."""
    r = random.Random(5)
    words = {"".join(r.sample("aaaaaabbbbbbbc", 14)) for _ in range(1500)} | {"".join(r.sample("aaaaaabbbbbbcc", 14)) for _ in range(1500)}
    counts = {w: 3 + k % 5 for k, w in enumerate(sorted(words))}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = {frozenset((x.a, x.b)) for x in spelling.near_words(frame).collect()}
    holes = {}
    for w in counts:
        for i in range(14):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert pairs == {frozenset((a, b)) for those in holes.values() for a in those for b in those if a < b}
    assert len(pairs) > 20


def test_empty_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []
    some = spark.createDataFrame([(1, "simple simples simple simples simple simples simple", "x", 2, 3)] * 3, "doc_id long, text string, word string, n long, key long")
    assert sorted(tuple(r) for r in spelling.spelling_variants(spelling.word_counts(some)).collect()) == plain(plain_counts([(1, "simple simples simple simples simple simples simple")] * 3))


def test_chains_are_followed_to_the_end(spark):
    chain = ["a" * 5 + "b" * k for k in range(12)]
    frame = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(frame).collect()}
    assert got == {w: (chain[k + 1] if k < 11 else None, chain[-1]) for k, w in enumerate(chain)}


def test_circles_are_refused(spark):
    with pytest.raises(RuntimeError):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), max_rounds=4)
