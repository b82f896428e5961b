import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle as fm
from tessera.llm.queries import op11_fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = [
    (1, "one two  three\nfour "), (2, ""), (3, None), (4, "   \t\n"), (5, "héé ünï 漢字  x \U0001F600 ok"),
    (6, "keep <P> as it is"), (7, "a"), (7, "a"), (None, "no id at all here"), (8, "<" * 40 + " S> <M P> " * 30),
    (9, " ".join("w" * (1 + 97 * (i % 2)) for i in range(4000))), (10, "z" * 200_000 + " end"),
    (11, "ab " * 90_000), *[(20 + i, f"text number {i} has some more words <S " * (i + 1)) for i in range(40)],
]


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_against_plain_python(spark, frame):
    made = fm.fill_in_middle(spark, frame(ROWS, "doc_id long, text string"))
    got = made.withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(brute(*r)) for r in ROWS)
    texts = {i: t or "" for i, t in ROWS}
    assert all(r.back == texts[r.doc_id] for r in got)
    assert {"plain", "spm", "psm"} <= {r.form for r in got}


def test_every_boundary_comes_exactly_out_of_the_index(spark, frame):
    rows = [r for r in ROWS if r[0] in (1, 4, 5, 8, 9)]
    index = fm.rank_index(spark, frame(rows, "doc_id long, text string"), fm.FillMiddleConfig(error=3))
    found = (index.select("*", F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("rank", "_r"))
             .select("doc_id", "rank", fm.offset_at(F.col("rank").cast("long")).alias("at")).collect())
    got = {(r.doc_id, r["rank"]): r["at"] for r in found}
    want = {}
    for doc_id, text in rows:
        at = 0
        for k, token in enumerate(["", *TOKEN.findall(text)]):
            at += len(token)
            want[doc_id, k] = at
    assert got == want


@pytest.mark.parametrize("error", [0, 5, 48])
def test_segments_keep_their_error(error):
    rng = random.Random(error)
    for widths in ([6] * 5000, [rng.randint(1, 12) for _ in range(20_000)], [1, 400] * 300, [7], []):
        at = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        first, slope = fm.fit_segments(at, error)
        off = at - fm.predictions(first, at[first], slope, len(at))
        assert np.abs(off).max() <= error + 1
    assert len(fm.fit_segments(np.arange(0, 60_000, 6), 1)[0]) == 1  # a straight line is one segment


def test_empty_table_other_columns_and_wrong_bound(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, form string")
    assert fm.fill_in_middle(spark, empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c", 9, "x", "y")], "doc_id long, text string, n int, residuals string, slope string")
    assert fm.fill_in_middle(spark, odd).select("n").first()[0] == 3
    with pytest.raises(ValueError):
        fm.rank_index(spark, empty, fm.FillMiddleConfig(error=101))


def test_query_restores_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r.doc_id, r.sha) for r in docs.select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).collect()}
    assert {(r.doc_id, r.restored_sha256) for r in op11_fill_middle(spark, sf).collect()} == want
