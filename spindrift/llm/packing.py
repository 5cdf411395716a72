"""Lexical retrieval packing (operator 8): fixed windows filled with the seed's BM25 neighbours.

Documents are brought into lexical order (by the tokens that weigh most in them) before they are dealt out in
shards, so that those with the same rare words lie in one shard. A shard is a stretch of that order, hence its
neighbours don't depend on how files were laid out, and many documents with one key are simply several shards.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import LONGEST_FAST, SPECIAL, VOCABULARY, load_ranks, merger, tokenizer_path

WINDOW = 2048
END = 1
#: Tokens (without full windows) after which a shard's index is built and packed; bounds a task's memory.
SHARD_TOKENS = 1_000_000
#: Texts that are held as Python strings and ids at once.
ROWS = 256
#: The end of the pattern that cuts texts, and what it comes to where no two spaces of any kind adjoin: without
#: its look-ahead the same cuts are found in half the time. Python's spaces are more than the pattern's, never fewer.
RUNS, SINGLE = r"|\s+(?!\S)|\s+", r"|\s+"
_ADJOINING = re.compile(r"\s\s")
_PAIRS, _OTHERS = ("  ", " \n", "\n ", "\n\n"), "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tokens that place a document in the lexical order.
ORDER_TERMS = 4
K1, B = 1.2, 0.75

_ENCODERS: dict[str, Callable[[str | None], bytes]] = {}


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str | None], bytes]:
    """From a whole text to its ids (as bytes of unsigned 16-bit numbers), the same as the tokenizers library gives."""
    if vocabulary not in _ENCODERS:
        ranks = load_ranks(tokenizer_path(f"{vocabulary}.tiktoken"))
        if len(ranks) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        plain, single = merger(vocabulary, ranks), single_merger(vocabulary, ranks)
        special = np.array([len(ranks)], "<u2").tobytes()

        def ids_of(part: str) -> bytes:
            ids = plain(part) if adjoining(part) or len(part) > LONGEST_FAST else single(part)
            return struct.pack(f"<{len(ids)}H", *ids)

        _ENCODERS[vocabulary] = lambda text: special.join([ids_of(part) for part in (text or "").split(SPECIAL)])
    return _ENCODERS[vocabulary]


def adjoining(text: str) -> bool:
    """Whether two spaces of any kind adjoin; the usual kinds are looked for first, which is much faster."""
    return any(map(text.__contains__, _PAIRS)) or (any(map(text.__contains__, _OTHERS)) and _ADJOINING.search(text) is not None)


def single_merger(vocabulary: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The fast encoder for strings in which no two spaces adjoin. With another pattern than is known, the usual one."""
    import public_tokenizers
    import tiktoken

    head = public_tokenizers.PATTERN.removesuffix(RUNS)
    pattern = public_tokenizers.PATTERN if head == public_tokenizers.PATTERN else head + SINGLE
    return tiktoken.Encoding(f"{vocabulary}_single", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, ids`` for each row: 16-bit ids of the whole text, then the end id. Null text: the end id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end = encoder(), np.array([END], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                ids = [encoded(t) + end for t in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(ids, pa.binary())], names=["_key", "ids"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text)).mapInArrow(encode, f"_key {kind}, ids binary")


def distinct(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each of several documents: which document, token, how often; sorted by both."""
    if not each:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.arange(len(each), dtype=np.uint32 if len(each) <= 1 << 16 else np.uint64)
    code, times = np.unique(np.repeat(number << 16, [len(x) for x in each]) | np.concatenate(each), return_counts=True)
    return (code >> 16).astype(np.int64), (code & 0xFFFF).astype(np.int64), times


def term_weights(each: list[np.ndarray], found: tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of what ``distinct`` found."""
    owner, term, tf = found
    size = np.array([len(x) for x in each], np.int64)[owner]
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1.0)))


def document_frequencies(ids: DataFrame, vocabulary_size: int = 1 << 16) -> tuple[np.ndarray, int, float]:
    """Documents that hold each token, documents, mean length: over all rows; a fixed-size vector reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(vocabulary_size, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                each = [np.frombuffer(raw.as_buffer(), "<u2") for raw in batch.column(0).slice(at, ROWS)]
                df += np.bincount(distinct(each)[1], minlength=vocabulary_size)
                n, length = n + len(each), length + sum(map(len, each))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([length, n, *df[at].tolist()], pa.int64())], names=["term", "n"])

    got = ids.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(got["term"], got["n"]))
    df = np.zeros(vocabulary_size)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    n = int(sums.get(-1, 0))
    return df, n, sums.get(-2, 0) / max(n, 1)


class Shard:
    """An inverted BM25 index over the rests (what full windows leave) of one shard's documents."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = self.held = len(rests)
        docs, term, _ = found = distinct(rests)
        # rounded, in the type that sums are made in
        weights = term_weights(rests, found, idf, mean).astype(np.float32).astype(np.float64)
        self.queries = np.split(term, np.searchsorted(docs, np.arange(1, self.n)))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.docs, self.weights, self.terms = docs[order], weights[order], term[order]
        self.starts = np.searchsorted(self.terms, np.arange((1 << 16) + 1))

    def forget(self, unused: np.ndarray) -> None:
        """Drops used documents from the index once they are a quarter of it; scores of the others stay."""
        if 4 * (n := np.count_nonzero(unused)) > 3 * self.held:
            return
        stays = unused[self.docs]
        self.docs, self.weights, self.terms, self.held = self.docs[stays], self.weights[stays], self.terms[stays], n
        self.starts = np.searchsorted(self.terms, np.arange((1 << 16) + 1))

    def neighbours(self, k: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with document ``k`` by BM25 over all its distinct terms, best first; ties by place."""
        self.forget(unused)
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.queries[k]]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start in its rest, length) that hold each token of ``rests`` once.

    Each rest, longest first, seeds a sequence that its best unused neighbours fill; the last one taken is cut
    to fit and what is left of it stays unused. Only the last sequence can be short: it is cut into lengths
    that are powers of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(rests), np.int64)
    left = np.array([len(x) for x in rests], np.int64)
    index = Shard(rests, idf, mean)
    order = np.argsort(-left, kind="stable")
    short: list[tuple[int, int, int]] = []
    at = 0
    while True:
        while at < len(order) and not left[order[at]]:
            at += 1
        if at == len(order):
            break
        seed, room, pieces = int(order[at]), window, []

        def take(k: int) -> None:
            nonlocal room
            n = int(min(left[k], room))
            pieces.append((k, int(start[k]), n))
            start[k] += n
            left[k] -= n
            room -= n

        take(seed)
        if room:
            for k in index.neighbours(seed, left > 0):
                take(int(k))
                if not room:
                    break
        later = at
        while room and later < len(order):
            if left[order[later]]:
                take(int(order[later]))
            later += 1
        if room:
            short = pieces
        else:
            out.append(pieces)
    total = sum(p[2] for p in short)
    queue = list(reversed(short))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, pieces = 1 << bit, []
        while room:
            k, s, n = queue.pop()
            m = min(n, room)
            pieces.append((k, s, m))
            if n > m:
                queue.append((k, s + m, n - m))
            room -= m
        out.append(pieces)
    return out


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def lexical_places(each: list[np.ndarray], idf: np.ndarray, mean: float) -> list[bytes]:
    """Documents' places in the lexical order: their tokens of the greatest BM25 weight, then a hash of all."""
    owner, term, _ = found = distinct(each)
    w = term_weights(each, found, idf, mean)
    ends = np.searchsorted(owner, np.arange(len(each) + 1)).tolist()
    out = []
    for x, lo, hi in zip(each, ends, ends[1:]):
        own = w[lo:hi]
        top = np.arange(hi - lo)
        if len(own) > ORDER_TERMS:
            top = np.flatnonzero(own >= np.partition(own, len(own) - ORDER_TERMS)[len(own) - ORDER_TERMS])
        top = top[np.argsort(-own[top], kind="stable")][:ORDER_TERMS]
        out.append(term[lo:hi][top].astype(">u2").tobytes().ljust(2 * ORDER_TERMS, b"\0") + zlib.crc32(x).to_bytes(4, "big"))
    return out


def lexical_order(ids: DataFrame, idf: np.ndarray, mean: float) -> DataFrame:
    """``ids`` dealt out and sorted by lexical place; the rest of the order is by content and key, so it is repeatable."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                where = lexical_places([np.frombuffer(raw.as_buffer(), "<u2") for raw in few.column(1)], idf, mean)
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(where, pa.binary())], names=["_key", "ids", "_place"])

    kind = ids.schema[0].dataType.simpleString()
    out = ids.mapInArrow(placed, f"_key {kind}, ids binary, _place binary")
    return out.repartitionByRange("_place", "_key").sortWithinPartitions("_place", "_key").select("_key", "ids")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: ``key``, then ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` (long).

    Ids are written once to the shared folder; document frequencies are counted over all of them. Ranges of the
    lexical order are dealt to tasks (however many documents share a place), and each stretch of about
    ``shard_tokens`` tokens is indexed and packed by itself; full windows of a long document stand alone and
    leave at once. Neighbours across the ends of a shard aren't found. Sequence ids combine partition and
    place: unique, and the same when a lost task runs again. Null and empty texts are the end id alone; each
    repeated row is a document of its own; null keys stay null; an empty table has no pieces; other columns
    don't matter.
    """
    ids = cut(token_ids(docs, key, text))
    df, n, mean = document_frequencies(ids)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    kind = ids.schema[0].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 36
        key_type = None
        held: list[tuple] = []  # key, start of the rest, the rest, tokens of the whole
        rows: list[tuple] = []
        size = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal next_id
            offset = 0
            for k, s, x, whole in pieces:
                rows.append((k, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), whole, next_id, offset))
                offset += len(x)
            next_id += 1

        def flush() -> None:
            for pieces in pack_shard([x for _, _, x, _ in held], idf, mean, window):
                emit([(held[d][0], held[d][1] + s, held[d][2][s : s + m], held[d][3]) for d, s, m in pieces])
            held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["_key", *PIECE])

        for batch in batches:
            key_type = batch.column(0).type
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), "<u2")
                whole = len(x) // window * window
                for s in range(0, whole, window):
                    emit([(k, s, x[s : s + window], len(x))])
                if len(x) > whole:
                    held.append((k, whole, x[whole:].copy(), len(x)))
                    size += len(x) - whole
                if size >= shard_tokens:
                    flush()
                    size = 0
                if len(rows) >= 10_000:
                    yield batch_of()
        if held:
            flush()
        if rows:
            yield batch_of()

    out = lexical_order(ids, idf, mean).mapInArrow(place, f"_key {kind}, " + ", ".join(f"{c} long" for c in PIECE))
    return out.withColumnRenamed("_key", key)


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
