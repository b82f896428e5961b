import re

import corpus_pipeline as P
from tessera.llm.decontaminate import best_match, normalize
from tessera.llm.queries import QUERIES

from test_near_dedup import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_their_own_input(spark, sf, scratch):
    """Each stage against a plain version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], sf).write.parquet(f"{scratch}/{k}")
        steps.append(spark.read.parquet(f"{scratch}/{k}"))
        assert name == P.STAGES[-1][0] or steps[-1].columns == columns
    before, clean, single, held, mixed, shards = [[r.asDict() for r in s.collect()] for s in steps]
    flagged = {r.doc_id for r in QUERIES["op3_toxicity"](spark, sf).collect() if r.predicted}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in before} - flagged

    groups = brute_components([(r["doc_id"], r["text"]) for r in clean], 5)
    assert {r["doc_id"] for r in single} == {d for d, (n, c) in groups.items() if n == 0 or c == d}

    items = [normalize(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in single if any(t in normalize(r["text"]) for t in items)}
    gone = {r["doc_id"] for r in single} - {r["doc_id"] for r in held}
    texts = {r["doc_id"]: r["text"] for r in single}
    assert exact <= gone
    assert all(min(best_match(t, normalize(texts[d]))[0] / len(t) for t in items) <= 0.08 for d in gone)

    total = sum(len(WORD.findall(r["text"])) for r in held)
    taken = sum(len(WORD.findall(r["text"])) for r in mixed)
    assert abs(taken - 1.5 * total) < 0.03 * total
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in held}

    rows = lambda xs: sorted(str([r[c] for c in columns]) for r in xs)
    assert rows(shards) == rows(mixed) and {r["shard"] for r in shards} == set(range(8))


def test_edge_cases_of_every_stage(spark, sf, frame):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here at all my friend", "en", "a", 5),
            (3, "same words in this text here", "en", "a", 28), (4, "same words in this text here", "en", "b", 28),
            (3, "same words in this text here", "en", "a", 28), (5, "w " * 20_000, "en", "b", 40_000)]
    docs = frame([(*r, 1) for r in rows], SCHEMA + ", component_id int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[:6] == docs.columns
        ids = sorted(r.doc_id or 0 for r in out.collect())
        if name in ("toxicity", "decontamination", "sharding"):
            assert ids == [0, 1, 2, 3, 3, 4, 5]
        elif name == "near_duplicates":
            assert ids == [0, 1, 2, 3, 5]
        else:
            assert not {1, 2} & set(ids)
        assert stage(spark, docs.limit(0), sf).collect() == []
