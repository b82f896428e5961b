import numpy as np
import pytest

from tessera.llm.decontaminate import (LeakConfig, LeakIndex, benchmark_leaks, best_match, clean_documents,
                                       find_leaks, normalize, windows_holding)
from tessera.llm.queries import QUERIES

LETTERS = list("abcdefghijklmnopqrstuvwxyz ")


def brute_best(pattern, text):
    """Least edits of pattern against any part of text (plain table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = int(rng.integers(len(out)))
        kind = rng.integers(3)
        if kind == 0:
            out[at] = rng.choice(LETTERS)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(LETTERS))
    return "".join(out)


def prose(rng, words):
    return " ".join("".join(rng.choice(LETTERS[:26], rng.integers(2, 9))) for _ in range(words))


def test_best_match_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pattern, text = prose(rng, 4), prose(rng, 12)
        if rng.random() < 0.7:
            at = int(rng.integers(len(text)))
            text = text[:at] + edited(rng, pattern, int(rng.integers(0, 5))) + text[at:]
        edits, start, end = best_match(pattern, text)
        assert edits == brute_best(pattern, text) == brute_best(pattern, text[start:end])


def test_query_equals_brute_force(spark, sf):
    """Every item of the sample, searched exactly in every document that could
    hold it: its q-grams are counted, which loses nothing."""
    docs = [(r.doc_id, normalize(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, normalize(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    cfg, q, want = LeakConfig(), 8, set()
    grams = {i: {t[j:j + q] for j in range(len(t) - q + 1)} for i, t in items}
    for d, text in docs:
        held = {text[j:j + q] for j in range(len(text) - q + 1)}
        for i, t in items:
            if len(grams[i] & held) >= len(grams[i]) - q * cfg.edits(len(t)):
                if best_match(t, text)[0] <= cfg.edits(len(t)):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, sf).collect()}
    assert got == want and want


@pytest.mark.parametrize("percent, least", [(2, 0.98), (5, 0.97), (8, 0.9)])
def test_recall_over_random_edits(percent, least):
    rng = np.random.default_rng(percent)
    items = [(i, prose(rng, int(rng.integers(20, 60)))) for i in range(120)]
    index = LeakIndex(items, LeakConfig())
    texts, n = [], 0
    for _, t in items:
        texts.append(" ".join([prose(rng, 40), edited(rng, t, len(t) * percent // 100), prose(rng, 40)]))
    found = {(doc, item) for doc, item, *_ in find_leaks(texts, index)}
    assert sum((i, i) in found for i, _ in items) >= least * len(items)
    assert all(d == i for d, i in found)


def test_edge_cases(frame, spark):
    rng = np.random.default_rng(9)
    item, other = prose(rng, 30), prose(rng, 25)
    long = " ".join([prose(rng, 20_000), item, prose(rng, 20_000)])
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, item.upper().replace(" ", "\n\t "), None),
            (4, item, "x"), (None, f"lead {item}", "x"), (5, prose(rng, 50), "x"), (6, "ß" * 50, "x")]
    docs = frame(rows, "doc_id long, text string, item_id string")
    bench = frame([(7, item), (8, item), (9, None), (10, ""), (11, other), (None, other)],
                  "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.item_id, r.edits) for r in
                 benchmark_leaks(spark, docs, bench).collect())
    hit = [(False, 3), (False, 4), (False, 4), (True, 0)]
    assert got == sorted((d, i, 0) for d in hit for i in (7, 8))
    small = LeakConfig(block_chars=100)  # several blocks of items give the same
    again = sorted(((r.doc_id is None, r.doc_id or 0), r.item_id, r.edits) for r in
                   benchmark_leaks(spark, docs, bench, small).collect())
    assert again == got
    left = clean_documents(spark, docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5, 6]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert benchmark_leaks(spark, none, items).collect() == []
    assert benchmark_leaks(spark, some, items.limit(0)).collect() == []


def test_items_inside_runs_without_spaces():
    rng = np.random.default_rng(11)
    han = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, n))
    thai = lambda n: "".join(chr(c) for c in rng.integers(0x0E01, 0x0E2F, n))
    latin = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    words = lambda n: " ".join(latin(5) for _ in range(n))
    items = [(1, han(60)), (2, thai(80)), (3, latin(70)), (4, words(12)), (5, words(14))]
    index = LeakIndex(items, LeakConfig())
    t = dict(items)
    texts = [han(300) + t[1] + han(200), thai(400) + t[2] + thai(90), latin(250) + t[3] + latin(120),
             "see " + latin(45) + t[4] + " " + words(20), words(9) + " " + "0" * 30 + ":" + t[5] + words(9), han(900)]
    want = [(d, i, 0, texts[d].index(t[i]), texts[d].index(t[i]) + len(t[i])) for d, i in enumerate((1, 2, 3, 4, 5))]
    assert sorted(find_leaks(texts, index)) == want


def test_recall_at_the_operators_bound():
    rng = np.random.default_rng(5)
    items = [(i, prose(rng, int(rng.integers(20, 60)))) for i in range(300)]
    cfg = LeakConfig()
    texts = [" ".join([prose(rng, 8), edited(rng, t, cfg.edits(len(t))), prose(rng, 8)]) for _, t in items]
    found = {(doc, item) for doc, item, *_ in find_leaks(texts, LeakIndex(items, cfg))}
    assert sum((i, i) in found for i, _ in items) >= 0.98 * len(items)


def test_windows_holding_counts_every_window():
    rng = np.random.default_rng(3)
    for _ in range(300):
        starts = np.flatnonzero(rng.random(60) < 0.6)
        at = np.flatnonzero(rng.random(80) < rng.random())
        width, floor = int(rng.integers(1, 30)), int(rng.integers(0, 8))
        want = [s for s in starts if ((at >= s) & (at < s + width)).sum() >= floor]
        assert windows_holding(starts, at, width, floor).tolist() == want


def test_walks_of_many_starts_equal_single_ones():
    rng = np.random.default_rng(6)
    items = [(i, "".join(rng.choice(LETTERS, 40 + 7 * i))) for i in range(12)]
    index = LeakIndex(items, LeakConfig(walks=3, samples=2))
    data = np.append(rng.choice(np.frombuffer(b"abc ", np.uint8), 900), np.uint8(0))
    starts = np.arange(0, 800, 7)
    alive = {c: np.flatnonzero(rng.random(len(starts)) < 0.5) for c in range(len(index.bounds))}
    alive = {c: own for c, own in alive.items() if len(own)}
    got = set(zip(*(column.tolist() for column in index.embed(data, starts, alive))))
    want = set()
    for c, own in alive.items():
        for i in own:
            for walk in range(3):
                at, seen = int(starts[i]), []
                for j in range(2 * index.shortest[c]):
                    seen.append(int(data[at]))
                    at += int(index.walk_bits[j, walk, data[at]])
                for s in range(2):
                    key = (c * 2 + s) * 3 + walk + 1
                    for p in index.positions[c][s]:
                        key = key << 8 | seen[p]
                    want.add((key, int(i)))
    assert got == want
