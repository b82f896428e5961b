import itertools
import re

import numpy as np
import pyarrow as pa

from tessera.llm.common import text_buffer
from tessera.llm.components import connected_components
from tessera.llm.common import Stash
from tessera.llm.near_dedup import NearDupConfig, near_duplicates, shingle_sets, signatures
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute_set(text, k):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, k, percent=80):
    sets = [(d, brute_set(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    held = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(i)
    common = {}
    for group in held.values():
        for i, j in itertools.combinations(group, 2):
            common[i, j] = common.get((i, j), 0) + 1
    for (i, j), c in common.items():
        (a, sa), (b, sb) = sets[i], sets[j]
        if 100 * c >= percent * (len(sa) + len(sb) - c):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in QUERIES["op6_near_dedup"](spark, sf).collect()}
    assert got == want
    assert any(c != d for d, (_, c) in want.items())


def test_edge_cases(frame, spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One", "x"), (5, "one", None),
            (6, long, "x"), (7, long + " tail", "x"), (8, base, "x"), (9, base, "x"),
            (9, base, "x"), (None, base, "x"), (10, base.upper(), "x"), (11, "a b c", "x")]
    docs = frame(rows, "doc_id long, text string, component_id string")
    for k in (2, 5):
        got = near_duplicates(spark, docs, NearDupConfig(shingle=k)).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        want = brute_components([(d, t) for d, t, _ in rows if d is not None], k)
        assert {d: (r.n_shingles, r.component_id) for d, r in by.items()} == want
        none = next(r for r in got if r.doc_id is None)
        assert none.component_id is None and none.kept
        assert by[1].n_shingles == 0 and by[1].kept and not by[5].kept and not by[9].kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, docs).collect() == []


def test_hub_links_copies_that_are_not_linked_to_each_other(frame, spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for d in range(60):  # each copy replaces its own words; two copies differ twice as much
        w = list(base)
        for p in rng.choice(200, 9, replace=False):
            w[p] = f"x{d}_{p}"
        rows.append((d, " ".join(w)))
    want = brute_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_duplicates(spark, frame(rows, "doc_id long, text string"),
                                    NearDupConfig(shingle=2)).collect()}
    assert got == want


def test_signature_matches_follow_the_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(45, 445))  # shares 354 of 444 pairs
    owner, code = shingle_sets(*text_buffer(pa.array([a, b, "one two"])), 2)
    sig = signatures(owner, code, 3, 240)
    assert abs((sig[0] == sig[1]).mean() - 354 / 444) < 0.1
    assert (sig[2] == sig[2][0]).all()  # one element fills every bin


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50, 80)] + [(200, i) for i in range(190, 230) if i != 200]
    edges += [(5, 5), (7, 6), (6, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(spark, df, Stash(spark, "t")).collect()}
    assert got == ({i: 50 for i in range(50, 81)} | {i: 190 for i in range(190, 230)} | {6: 6, 7: 6})


def test_dense_family_keeps_every_link(frame, spark):
    """Copies with few to many edits, some of them shared: links near the
    threshold between copies that are not linked to the most central one."""
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(150)]
    shared = {p: f"s{p}" for p in range(0, 150, 7)}
    rows = []
    for d in range(220):
        w = list(base)
        for p in rng.choice(150, rng.integers(1, 26), replace=False):
            w[p] = shared.get(p, f"x{d}_{p}") if rng.random() < 0.8 else ""
        rows.append((d, " ".join(w)))
    want = brute_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_duplicates(spark, frame(rows, "doc_id long, text string"),
                                    NearDupConfig(shingle=2)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 5
