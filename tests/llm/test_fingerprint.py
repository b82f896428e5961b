import hashlib

import numpy as np
import pyarrow as pa

from tessera.llm.common import text_buffer
from tessera.llm.fingerprint import (BOUND, BUCKETS, compare, digests, encode, fingerprint_edits, fingerprints)
from tessera.llm.queries import QUERIES


def brute_print(text):
    data = text.encode()
    counts = [0] * BUCKETS
    for i in range(len(data) - 2):
        code = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
        counts[(code * 2654435761 & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    top = max(q3, 1)
    out = bytes([min(int(8 * np.log2(len(data) + 1)), 255), 15 * q1 // top << 4 | 15 * q2 // top])
    quart = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    for i in range(0, BUCKETS, 4):
        out += bytes([quart[i] << 6 | quart[i + 1] << 4 | quart[i + 2] << 2 | quart[i + 3]])
    return out.hex()


def check(rows, docs):
    """docs: (doc_id, text) in descending order of ids."""
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_print(t) and r.edited_fingerprint == brute_print(edited)
        assert abs(r.near_edited - compare([r.fingerprint], [r.edited_fingerprint])[0]) < 1e-12
        assert abs(r.near_next - compare([r.fingerprint], [brute_print(after)])[0]) < 1e-12
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_query_equals_brute_force(spark, sf):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = QUERIES["op9_fingerprint"](spark, sf).collect()
    check(rows, docs)
    edited = np.array([r.near_edited for r in rows])
    other = np.array([r.near_next for r in rows])
    assert (edited > other).mean() > 0.95


def test_edge_cases(frame, spark):
    rows = [(9, "abc"), (7, None), (5, ""), (3, "ä" * 3), (1, "long text " * 30_000), (-4, "x")]
    docs = frame([(d, t, "z") for d, t in rows], "doc_id long, text string, fingerprint string")
    check(fingerprint_edits(spark, docs).collect(), [(d, t or "") for d, t in rows])
    check(fingerprint_edits(spark, docs.where("doc_id = 3")).collect(), [(3, "äää")])
    assert fingerprint_edits(spark, docs.limit(0)).collect() == []
    same = frame([(2, "one text"), (2, "one text"), (None, "tail"), (1, "one text")], "doc_id long, text string")
    got = fingerprint_edits(spark, same).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id}) == 1
    none = next(r for r in got if r.doc_id is None)  # after all others, then the first follows
    assert none.edited_sha256 == hashlib.sha256(b"tai" + b"o").hexdigest()
    assert {r.fingerprint for r in fingerprints(docs.where("doc_id = 7")).collect()} == {brute_print("")}


def test_likeness_is_bounded_and_symmetric():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in (0, 2, 50, 500, 5000)]
    prints = encode(digests(*text_buffer(pa.array(texts))))
    for a in prints:
        assert compare([a], [a])[0] == 1
        for b in prints:
            x, y = compare([a], [b])[0], compare([b], [a])[0]
            assert x == y and 0 <= x <= 1
    assert BOUND > 0
