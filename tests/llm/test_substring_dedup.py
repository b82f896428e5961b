import random

import numpy as np

from tessera.llm import substring_dedup as sd
from tessera.llm.common import text_buffer
from tessera.llm.queries import op13_substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, window=20):
    """Kept words of every (doc_id, text) by a dictionary of all windows."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        w = (text or "").split()
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i:i + window]), (doc_id, i))
    for doc_id, text in rows:
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] < (doc_id, i):
                gone[i:i + window] = [True] * window
        out[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def corpus(seed, letters="abcdefghij", n=150):
    """Texts that share passages, whole and cut, with edits and repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2))))
    shared = [[word() for _ in range(rng.randint(15, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.choice((0, rng.randrange(len(p))))
                parts += p[a:a + rng.choice((len(p), 21, 25, 40))]
            else:
                parts += [word() for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.1:
            parts += ["la"] * rng.randint(10, 70) + ["do", "re"] * rng.randint(5, 30)
        rows.append((i * 7 % 151, rng.choice(("", " \n")) + rng.choice((" ", "\n", "  ")).join(parts)))
    return rows


def kept(spark, rows, cfg=sd.RepeatConfig(), parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in sd.remove_repeats(spark, df, cfg).collect()}


def test_against_all_windows(spark):
    for seed, letters in ((1, "abcdefghij"), (2, "ab"), (3, "abc")):
        rows = corpus(seed, letters)
        assert kept(spark, rows) == brute(rows)


def test_small_cache_spread_anchors_and_other_windows(spark):
    rows = corpus(4, "abcd")
    assert kept(spark, rows, sd.RepeatConfig(cache=8), 2) == brute(rows)
    assert kept(spark, rows, sd.RepeatConfig(sample=1, frequent=10 ** 9), 4) == brute(rows)  # all frequent
    assert kept(spark, rows, sd.RepeatConfig(window=7, anchor=4)) == brute(rows, 7)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "short text"), (5, long), (6, long + " x"), (7, "same " * 5000),
            (8, "same " * 19), (9, "é漢 " * 20), (10, "x é漢 " + "é漢 " * 20)]
    assert kept(spark, rows) == brute(rows)
    twice = kept(spark, rows + [(5, long)])  # a repeated row is no earlier document
    assert twice == brute(rows)
    text = " ".join(f"v{i}" for i in range(30))
    none = spark.createDataFrame([(None, text), (3, text), (None, "other " + text)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.remove_repeats(spark, none).collect())
    assert got == [(0, 30), (0, 30), (3, 0)]  # null ids come last
    empty = spark.createDataFrame([], SCHEMA + ", at int, size int, spans string")
    assert sd.remove_repeats(spark, empty).collect() == []


def test_other_columns_do_no_harm(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 1, "a", 2), (2, text, 1, "a", 2)], SCHEMA + ", twin int, spans string, doc int")
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(spark, df).collect()} == {1: 0, 2: 30}


def test_factors_name_an_earlier_place(spark):
    rows = corpus(6)
    words = {i: t.split() for i, t in rows}
    got = sd.factors(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    covered = {}
    for f in got:
        assert f.length >= 20 and (f.ref_doc_id, f.ref_start) < (f.doc_id, f.start)
        assert (words[f.doc_id][f.start:f.start + f.length]
                == words[f.ref_doc_id][f.ref_start:f.ref_start + f.length])
        covered.setdefault(f.doc_id, set()).update(range(f.start, f.start + f.length))
    assert {i: len(covered.get(i, ())) for i in words} == {i: r[1] for i, r in brute(rows).items()}
    whole = sd.factors(spark, spark.createDataFrame([(1, "a b c " * 9 + " ".join(map(str, range(300)))),
                                                     (2, " ".join(map(str, range(300))))], SCHEMA))
    assert [(f.start, f.length, f.ref_doc_id, f.ref_start) for f in whole.where("doc_id = 2").collect()] == [
        (0, 300, 1, 27)]


def test_blocks_cover_every_window_once_and_depend_on_words_alone():
    import pyarrow as pa
    cfg = sd.RepeatConfig()
    rng = random.Random(9)
    core = [f"c{rng.randrange(50)}" for _ in range(200)]
    found = []
    for around in (["x"] * 3, [f"y{i}" for i in range(70)]):
        data, offsets = text_buffer(pa.array([" ".join(around + core + around)]))
        starts, ends, row = sd.words(data, offsets)
        first, end, anchor, block = sd.blocks(sd.span_hashes(data, starts, ends), row, cfg)
        assert first[0] == 0 and end[-1] == len(starts)
        assert np.array_equal(end[:-1] - cfg.window + 1, first[1:])
        inner = (first >= len(around)) & (end <= len(around) + 200)
        found.append([*zip(first[inner] - len(around), end[inner] - len(around), anchor[inner], block[inner])])
    assert len(set(found[0]) & set(found[1])) >= min(map(len, found)) - 2 > 10


def test_query_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in op13_substring_dedup(spark, sf).collect()}
    assert got == {k: v[:2] for k, v in want.items()} and sum(v[1] for v in got.values()) > 0
    assert "kept_sha256" in op13_substring_dedup(spark, sf).columns
