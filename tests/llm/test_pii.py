import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm.pii import KINDS, PiiConfig, find_personal_data, mask, span_list
from tessera.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [getattr(r, f"n_{k}") for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == joined or r.spans.startswith(joined) and ("id:" in r.spans)


def test_query_equals_plain_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


TRICKY = [
    "a@b.c_d@e.f.g a@b a@b. x@y.z@w.v ..@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.0 1.2.3", "9" * 5000,
    "4539 1488 0343 6467 4539-1488-0343-6467 4539148803436467 4539  148803436467", "1 2 3 4 " * 3000,
    "+1 (017) 555-7713 +12 +1.2.3.4.5.6.7.8.9 + 12345678901 +1234567890123456", "é😀 a@b.cd 😀 1.1.1.1",
    "\x01a@b.cd\x02 \x03", "a" * 20_000 + "@" + "b" * 20_000 + ".c", "a." * 9000 + "@x", None, "", "@", "+", "+1 2",
]


def test_tricky_texts(frame, spark):
    rows = [(i, t, 1) for i, t in enumerate(TRICKY)] + [(None, "a@b.cd", 1), (5, TRICKY[5], 1)]
    docs = frame(rows, "doc_id long, text string, email int")
    found = find_personal_data(spark, docs)
    got = found.select("doc_id", *[F.size(k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(span_list({k: k for k in KINDS}), 256).alias("base_sha256"),
                       span_list({k: k for k in (*KINDS, "id")}).alias("spans")).collect()
    assert len(got) == len(rows)
    check([r for r in got if r.doc_id is not None], dict(enumerate(TRICKY)))
    assert next(r for r in got if r.doc_id is None).n_email == 1
    assert find_personal_data(spark, docs.limit(0)).collect() == []


def test_patterns_discover_unseen_identifiers(frame, spark):
    rows = [(i, f"please write to user{i}@mail{i}.example.com or call now") for i in range(8)]
    rows += [(20 + i, f"some words before we write to HB-20{i}-7741-XQ, and more") for i in range(3)]
    rows += [(40 + i, f"section {i}00{i}1234 says nothing of note") for i in range(6)]
    docs = frame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_personal_data(spark, docs, PiiConfig(context=2)).collect()}
    texts = dict(rows)
    for d, t in texts.items():
        found = [t[s.s:s.e] for s in got[d].id]
        assert found == ([re.search(r"HB-\S+Q", t).group()] if 20 <= d < 40 else [])


def test_mask(spark):
    df = spark.sql("select 'ab 1.1.1.1 é' t, array(named_struct('s', 3, 'e', 10)) x")
    assert df.select(mask(F.col("t"), F.col("x"), "*")).first()[0] == "ab ******* é"


def test_grouped_and_short_identifiers(frame, spark):
    rows = [(i, f"Word here phone: +49 30 55501{i:02d} and more") for i in range(20)]
    rows += [(20 + i, f"Write to contact: user{i}@mail.example and more") for i in range(20)]
    rows += [(50, "Word phone: 030 123 4567 then"), (51, "a phone: DE89 3704 0044 0532, then 12 apples"),
             (52, "his contact: @someone is"), (53, "phone: AB-123 here"), (54, "then 077 456 1122 alone")]
    got = {r.doc_id: [tuple(x) for x in r.id] for r in
           find_personal_data(spark, frame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    found = {i: [texts[i][s:e] for s, e in got[i]] for i in range(50, 55)}
    assert found == {50: ["030 123 4567"], 51: ["DE89 3704 0044 0532"], 52: ["@someone"], 53: ["AB-123"], 54: []}
