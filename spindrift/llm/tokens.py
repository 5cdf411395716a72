"""Token counts of whole texts (operator 1).

A byte-level BPE tokenizer first cuts a text with a fixed pattern and then merges inside each cut. No cut
spans a non-space character followed by a space, so a text can be split there and every piece encoded by
itself. Natural text repeats its pieces; the first distinct ones that a task meets are encoded once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k"
#: Distinct pieces remembered by a task; further ones are encoded each time they occur.
REMEMBERED = 50_000
#: A longer piece (a space-free run) is encoded each time rather than remembered.
LONGEST_KEY = 64
#: Characters that some pattern may call space, wide on purpose.
_SPACES = "\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_BEFORE_SPACE = re.compile(f"[{_SPACES}] ")
LIMIT = 512
#: The vocabulary's one special token; the library finds its string inside texts.
SPECIAL = "<|endoftext|>"
#: Longer strings go to the library itself: the fast encoder's stack overflows on about a million spaces in a row.
LONGEST_FAST = 200_000


def tokenizer_path(name: str = f"{VOCABULARY}.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Remembers ``encode(piece)`` for the pieces of texts; ``of(text)`` lists the values in order."""

    def __init__(self, encode, special: str = "", special_value=None):
        super().__init__()
        self.encode, self.special, self.special_value = encode, special, special_value

    def __missing__(self, piece: str):
        value = self.encode(piece)
        if len(self) < REMEMBERED and len(piece) <= LONGEST_KEY:
            self[piece] = value
        return value

    def _plain(self, text: str) -> list:
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or _SPACE_BEFORE_SPACE.search(text):
            return [self[p] for p in _runs(text)]
        first, *rest = text.split(" ")
        return [self[first], *map(self.__getitem__, map(" ".__add__, rest))]

    def of(self, text: str | None) -> list:
        if not text:
            return []
        if not self.special or self.special not in text:
            return self._plain(text)
        out: list = []
        for k, part in enumerate(text.split(self.special)):
            if k:
                out.append(self.special_value)
            out += self._plain(part)
        return out


def _runs(text: str) -> list[str]:
    """Spaces and what follows them, cut wherever a space follows a character that is surely no space."""
    out, at = [], 0
    for m in re.finditer(f"(?<=[^{_SPACES}]) ", text):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merger(vocabulary: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Ids of a string without special tokens in it, the same as the tokenizers library gives, mostly faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    library: list[Tokenizer] = []

    def merge(text: str) -> list[int]:
        if len(text) <= LONGEST_FAST:
            return fast(text)
        if not library:
            library.append(Tokenizer.from_file(tokenizer_path(f"{vocabulary}.json")))
        return library[0].encode(text, add_special_tokens=False).ids

    return merge


def whole_tokens(ranks: dict[bytes, int], merge) -> frozenset[str]:
    """The proof: vocabulary strings that, encoded alone, come out as one token.

    A string of the vocabulary need not be reached by the merges that start from its own bytes (an
    earlier merge can take a byte that it needs), so each is merged once and kept only if one id remains.
    Byte strings that aren't valid UTF-8 can't be a pre-token and are left out.
    """
    kept = []
    for raw in ranks:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(merge(text)) == 1:
            kept.append(text)
    return frozenset(kept)


@lru_cache(1)
def _proven(vocabulary: str) -> tuple[Callable[[str], list[int]], frozenset[str]]:
    """The merger and the proven set, as large as the vocabulary; a worker makes them once."""
    ranks = load_ranks(tokenizer_path(f"{vocabulary}.tiktoken"))
    merge = merger(vocabulary, ranks)
    return merge, whole_tokens(ranks, merge)


def piece_counter(vocabulary: str = VOCABULARY) -> Pieces:
    """Counts tokens: pre-tokens of the proven set count one, only the rest are merged."""
    import public_tokenizers
    import regex

    merge, whole = _proven(vocabulary)
    cut = regex.compile(public_tokenizers.PATTERN).findall

    def count(piece: str) -> int:
        if piece in whole:
            return 1
        if piece.lstrip(" ").isalpha() and piece.rfind(" ") < 1:  # letters after at most one space: one pre-token
            return len(merge(piece))
        return sum(1 if p in whole else len(merge(p)) for p in cut(piece))

    return Pieces(count, SPECIAL, 1)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; earlier columns so named go.

    Null and empty texts have 0 of each. Rows are independent: repeated rows and null keys are kept as
    they are, an empty table gives an empty one. Texts are counted whole, however long. A map-only plan:
    no shuffle, one text and one bounded table of remembered pieces in memory.
    """

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = piece_counter(vocabulary)  # what it remembers goes with the task
        for texts in batches:
            yield pd.Series([sum(counter.of(t)) for t in texts], dtype="int64")

    n = F.pandas_udf(counts, "long")
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    return kept.withColumns(
        {"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "n_tokens": n(F.col(text))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
