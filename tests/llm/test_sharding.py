import zlib

import numpy as np

from tessera.llm.queries import QUERIES
from tessera.llm.sharding import ShardConfig, hilbert_index, shard_documents, write_shards


def test_hilbert_curve_visits_every_cell_once_in_unit_steps():
    for bits, dims in ((3, 2), (2, 3), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, shards):
    """Sizes, groups, slots and balance of a result."""
    by_shard, where = {}, {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by_shard.setdefault(r.shard, []).append(r)
        assert where.setdefault(t, r.shard) == r.shard
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        held.sort(key=lambda r: r.slot)
        assert [r.curve for r in held] == sorted(r.curve for r in held)
    groups = {}
    for r in rows:
        groups[texts[r.doc_id] or ""] = groups.get(texts[r.doc_id] or "", 0) + r.size
    goal, largest = sum(r.size for r in rows) / shards, max(groups.values())
    edges = sorted((s, sum(r.size for r in held)) for s, held in by_shard.items())
    assert all(abs(size - goal) <= largest for _, size in edges)


def test_query_keeps_the_law(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_shard"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    check(rows, texts, 8)


def test_edge_cases_and_hot_group(frame, spark):
    rows = [(i, "same text", "hot", ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100 + i, f"text {i} " + "x" * (37 * i % 200), f"s{i % 7}", "en") for i in range(120)]
    rows += [(300, None, None, None), (301, "", "s1", None), (302, "long " * 5000, "s2", "fr"), (None, "n", "s", "en")]
    schema = "doc_id long, text string, source string, lang string"
    docs = frame([(*r, 1) for r in rows], schema + ", shard int")
    got = shard_documents(spark, docs.drop("shard")).collect()
    assert len(got) == len(rows)
    check(got, {r[0]: r[1] for r in rows}, 8)
    whole = shard_documents(spark, docs.withColumnRenamed("shard", "curve_x"), carry=True)
    assert whole.columns == ["doc_id", "text", "source", "lang", "curve_x", "shard", "slot", "curve"]
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in whole.collect()) == \
        sorted((r.doc_id or -1, r.shard, r.slot) for r in got)
    again = shard_documents(spark, docs.drop("shard")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shard_documents(spark, docs.limit(0)).collect() == []


def test_files_cover_small_boxes(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = write_shards(spark, docs, f"{scratch}/shards", ShardConfig(shards=4), files_per_shard=4)
    assert table.count() == docs.count()
    spans = table.selectExpr("input_file_name() f", "lang").groupBy("f").agg({"lang": "collect_set"}).collect()
    assert len(spans) > 8
    assert sum(len(r[1]) for r in spans) / len(spans) < 2.5  # of four languages


def test_sources_that_share_their_beginning(frame, spark, scratch):
    rows = [(i, f"text {i} " + "x" * (37 * i % 200), f"https://site-{i % 16:02d}.example/", None if i % 5 else "en") for i in range(640)]
    docs = frame(rows, "doc_id long, text string, source string, lang string")
    table = write_shards(spark, docs, f"{scratch}/shards", ShardConfig(shards=4), files_per_shard=4)
    spans = table.selectExpr("input_file_name() f", "source").groupBy("f").agg({"source": "collect_set"}).collect()
    assert len(spans) > 8
    assert sum(len(r[1]) for r in spans) / len(spans) < 8  # of 16 sources
    alone = shard_documents(spark, docs.selectExpr("doc_id", "'same' || doc_id text", "source", "'en' lang")).collect()
    assert len({r.curve for r in alone}) >= 16
