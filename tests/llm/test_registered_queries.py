"""Registered queries on the smallest tables against plain versions of their digests."""

import base64
import hashlib
import re

from spindrift.llm import tokens
from spindrift.llm.queries import QUERIES


def rows_of(spark, data, name):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()], QUERIES[name](spark, data).collect()


def test_op1_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    docs, got = rows_of(spark, data, "op1_token_counts")
    encode = Tokenizer.from_file(tokens.tokenizer_path()).encode
    wanted = sorted((i, len((t or "").encode()), len(encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == wanted
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_op3_digests(spark, data):
    docs, got = rows_of(spark, data, "op3_secret_scan")
    kinds = {
        "assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
    }
    by = {r.doc_id: r for r in got}
    assert len(by) == len(docs)
    for i, t in docs:
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, g, least)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if len(m[g]) >= least]
        r, base = by[i], [s for *_, s in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == base


def test_op7_equals_a_plain_reading(spark, data):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    first = {}
    for i, body in sorted(pages):
        first.setdefault(body, i)
    wanted = sorted((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", "" if first[b] == i else first[b]) for i, b in pages)
    got = QUERIES["op7_arc_to_warc"](spark, data).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, "" if r.refers_to is None else r.refers_to) for r in got) == wanted
    assert all(r.intact for r in got)
