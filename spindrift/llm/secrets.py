"""Secret scans (operator 3): fixed patterns, plus guess-cost scoring of values in a credential context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import VOCABULARY, load_ranks, tokenizer_path

# The base patterns. Keywords match in either case of A-Z only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: What makes a value worth scoring: a credential word, a separator, then at least six visible characters.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?|bearer|auth)["']?\s{0,8}(?::=|=>|[:=])\s{0,8}["'`]?([^\s"'`<>]{6,})"""
)
#: A value that needs 10**9 guesses or more counts as a secret.
GUESSES = 9.0
#: Words that guessing programs try first, most common first; the words of a vocabulary follow by rank.
COMMON = """password admin welcome login letmein qwerty dragon master monkey shadow sunshine princess football baseball
superman batman trustno secret access hello freedom whatever changeme default guest root user test demo example sample
token key name value none null true false public private server client system network internet computer service account
summer winter spring autumn monday friday love money happy lucky star king queen tiger eagle soccer hockey
january february march april may june july august september october november december""".split()
# The rows of a keyboard, along which walks go.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}
_LEET = str.maketrans("013457$@", "oieastsa")
#: Dates: year first or last, in full or two digits, with or without separators; then years. Guesses as log10.
_D, _M, _Y = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
_DATES = tuple(
    (re.compile(p), cost)
    for p, cost in (
        (rf"{_Y}([-/._]?){_M}\1{_D}", 4.7), (rf"{_D}([-/._]?){_M}\1{_Y}", 4.7), (rf"{_M}([-/._]?){_D}\1{_Y}", 4.7),
        (r"[1-9]\d?([-/._])[1-9]\d?\1(?:19|20)?\d\d", 4.7), (rf"\d\d{_M}{_D}", 4.6), (rf"{_D}{_M}\d\d", 4.6), (_Y, 2.1),
    )
)
LONGEST_WORD = 24


@lru_cache(1)
def common_words(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """log10 of a word's rank: the common ones, then the words of a public byte-pair vocabulary, which learns the
    most frequent first. As large as the vocabulary."""
    ranked = (raw.decode("ascii", "ignore").strip().lower() for raw in load_ranks(tokenizer_path(f"{vocabulary}.tiktoken")))
    words = dict.fromkeys([*COMMON, *(w for w in ranked if len(w) >= 3 and w.isalpha())])
    return {w: log10(k + 2) for k, w in enumerate(words)}


def dates_at(value: str, i: int) -> list[tuple[int, float]]:
    """Ends and costs of the dates that start at ``i``."""
    return [(m.end(), cost) for p, cost in _DATES if (m := p.match(value, i))]


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    ``best[i]`` is the cost of the first i characters; each step adds a brute-force character, a word
    (plain, capitalised or with digits for letters), a date, a repeat or a keyboard walk. Linear in the
    value's length: words are at most ``LONGEST_WORD`` long, repeats and walks are taken as maximal runs.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [float("inf")] * n
    longest = min(LONGEST_WORD, max(map(len, words), default=0))
    same_to, walk_to = list(range(1, n + 1)), list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if value[i] == value[i + 1]:
            same_to[i] = same_to[i + 1]
        if (low[i], low[i + 1]) in _NEXT:
            walk_to[i] = walk_to[i + 1]
    for i in range(n):
        here = best[i]
        c = value[i]
        brute = 1.0 if c.isdigit() else 1.42 if c.isalpha() else 1.52
        best[i + 1] = min(best[i + 1], here + brute)
        if same_to[i] - i >= 3:
            j = same_to[i]
            best[j] = min(best[j], here + brute + log10(j - i) + 0.3)
        if walk_to[i] - i >= 3:
            j = walk_to[i]
            best[j] = min(best[j], here + log10(72 * (j - i)) + 0.3)
        for j, cost in dates_at(value, i) if c.isdigit() else ():
            best[j] = min(best[j], here + cost + 0.3)
        for j in range(i + 3, min(n, i + longest) + 1):
            cost = words.get(low[i:j])
            if cost is None and (cost := words.get(plain[i:j])) is not None:
                cost += 0.6
            if cost is not None:
                cost += 0.3 * (low[i:j] != value[i:j])
                best[j] = min(best[j], here + cost + 0.3)
    return best[n]


def spans_of(text: str, threshold: float = GUESSES) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end): code points, end exclusive, by start, then by kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            if len(value) < 6:
                continue
            if guess_cost(value, common_words()) >= threshold:
                found.append(("guess", m.start(1), m.start(1) + len(value)))
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t or "")] for t in texts], dtype="object")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) over each whole text.

    Kinds ``assign``, ``access`` and ``hex`` follow fixed patterns; ``guess`` marks a value in a
    credential context whose cheapest segmentation (words, dates, repeats, keyboard walks, brute force)
    takes 10**9 guesses or more, however often the text repeats it. Spans of different kinds may overlap.
    Null and empty texts give an empty array, an empty table an empty one; texts are scanned whole, however
    long; an earlier ``secrets`` column is replaced; repeated rows and null keys stay. Map-only: no shuffle.
    """
    return docs.withColumn("secrets", F.pandas_udf(_spans, "array<struct<kind:string,start:int,end:int>>")(F.col(text)))


def joined(spans) -> F.Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
