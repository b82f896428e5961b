import os
import zlib
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity
from tessera.llm.common import fold_case, text_buffer
from tessera.llm.queries import QUERIES, toxic_model
from tessera.llm.toxicity import (KernelMap, Subsequences, ToxicConfig, clean_documents, normalised_kernel,
                                  score_toxicity, spell, subsequence_kernel, train_model, units)

SCHEMA = "doc_id long, text string, toxic int"


def brute_kernel(s, t, order, decay):
    def weights(x):
        out = {}
        for at in combinations(range(len(x)), order):
            key = tuple(x[i] for i in at)
            out[key] = out.get(key, 0) + decay ** (at[-1] - at[0] + 1)
        return out
    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_kernel_equals_brute_force():
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in (1, 2, 3, 4, 5, 6, 7, 8)]
    block = np.zeros((len(words), 8), np.uint8)
    for i, w in enumerate(words):
        block[i, :len(w)] = list(w)
    for t in words[2:]:
        got = subsequence_kernel(block, t, 3, 0.7)
        assert np.allclose(got, [brute_kernel(w, t, 3, 0.7) for w in words], rtol=1e-4, atol=1e-6)
    same = normalised_kernel(words, words[2:], ToxicConfig())
    assert np.allclose(same[2:].diagonal(), 1, atol=1e-4) and same.max() < 1.001 and (same[:2] == 0).all()


def test_table_of_subsequences_equals_brute_force():
    rng = np.random.default_rng(9)
    for order in (2, 3, 4):
        words = [bytes(rng.choice(list(b"abcde\xc3"), n).tolist()) for n in [*range(1, 17), 5, 12, 16]]
        landmarks = words[3:11] + [b"aaaaa"]
        block = np.zeros((len(words), 16), np.uint8)
        for i, w in enumerate(words):
            block[i, :len(w)] = list(w)
        got = Subsequences(landmarks, order, 0.7).kernel(block)
        want = [[brute_kernel(w, t, order, 0.7) for t in landmarks] for w in words]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
    assert not Subsequences([b"ab" * 20], 3, 0.7).fits
    long = [b"abcab" * 8, b"abc"]  # beyond the table: the recurrence
    cfg = ToxicConfig()
    table = Subsequences([b"abcab"], cfg.order, cfg.decay)
    assert np.allclose(normalised_kernel(long, [b"abcab"], cfg, table), normalised_kernel(long, [b"abcab"], cfg))


def test_sentences_take_the_largest_of_their_units():
    rng = np.random.default_rng(2)
    kernel = KernelMap([b"\x01idiot", b"\x01clown"], ToxicConfig())
    for dtype in (np.float16, np.float32):
        values = rng.random((400, 2)).astype(dtype)
        sentence = np.sort(rng.integers(0, 60, 400))
        want = np.zeros((61, 2), np.float32)
        for i, s in enumerate(sentence):
            want[s] = np.maximum(want[s], values[i])
        assert np.array_equal(kernel.sentences(values, sentence, 61), want @ kernel.root)
    assert (kernel.sentences(np.zeros((0, 2)), np.zeros(0, int), 3) == 0).all()


def test_units_and_sentences():
    data, offsets = text_buffer(pa.array(["Oh, you i d i o t! No.\nEnd (so-called)", None, "...", "ÉTÉ x"]))
    folded = fold_case(data)
    starts, ends, sentence, rows = units(folded, offsets)
    got = [(spell(folded, s, e)[1:].decode(), int(k)) for s, e, k in zip(starts, ends, sentence)]
    assert got == [("oh", 0), ("you", 0), ("idiot", 0), ("no", 1), ("end", 2), ("socalled", 2), ("été", 4), ("x", 4)]
    assert rows.tolist() == [0, 0, 0, 2, 3]


def prose(rng, n):
    syllables = ["ta", "lo", "mir", "sen", "ved", "ko", "pan", "ru"]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        text = [prose(rng, 12) for _ in range(4)]
        if i % 4 == 0:
            w = text[2].split(" ")
            w.insert(5, str(rng.choice(["nitwit", "scoundrel", "buffoon"])))
            text[2] = " ".join(w)
        rows.append((i, "\n".join(text), int(i % 4 == 0)))
    return train_model(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_gapped_and_inserted_insults(frame, model):
    rng = np.random.default_rng(2)
    bad = ["nitwit", "n i t w i t", "nit-wit", "n.i.t.w.i.t", "scounddrel", "Buffoon!", "buff*oon", "scoundrels"]
    rows = [(i, f"{prose(rng, 20)} {prose(rng, 4)[:-1]} {w} {prose(rng, 5)}", 0) for i, w in enumerate(bad)]
    rows += [(100 + i, " ".join(prose(rng, 15) for _ in range(3)), 0) for i in range(100)]
    got = {r.doc_id: r for r in score_toxicity(frame(rows, SCHEMA).drop("toxic"), model).collect()}
    assert sum(got[i].predicted for i in range(len(bad))) >= len(bad) - 1
    assert sum(got[i].predicted for i in range(100, 200)) == 0


def test_more_unlike_insults_than_common_landmarks(frame, spark):
    rng = np.random.default_rng(7)
    bad = ["".join(rng.choice(list("aeioubdklmnprstv"), 8)) for _ in range(40)]
    # the first ones are frequent and have many different endings
    picks = [bad[i % 40] if i < 760 else bad[i % 6] + "".join(rng.choice(list("aeiou"), 2)) for i in range(960)]
    rows = [(i, f"{prose(rng, 8)}\n{prose(rng, 4)[:-1]} {w} {prose(rng, 4)}", 1) for i, w in enumerate(picks)]
    rows += [(10_000 + i, f"{prose(rng, 8)}\n{prose(rng, 9)}", 0) for i in range(960)]
    model = train_model(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))
    test = [(i, f"{prose(rng, 20)} {prose(rng, 4)[:-1]} {w} {prose(rng, 5)}", 0) for i, w in enumerate(bad)]
    test += [(100 + i, " ".join(prose(rng, 15) for _ in range(3)), 0) for i in range(100)]
    got = {r.doc_id: r for r in score_toxicity(frame(test, SCHEMA).drop("toxic"), model).collect()}
    assert [w for i, w in enumerate(bad) if not got[i].predicted] == []
    assert sum(got[i].predicted for i in range(100, 200)) <= 2


def test_edge_cases(frame, spark, model):
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, ""), (3, "12 ... !"), (4, "x" * 30_000), (5, (prose(rng, 2000) + " ") * 10 + " nitwit"),
            (None, "you nitwit"), (6, "nitwit"), (6, "nitwit")]
    docs = frame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = score_toxicity(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by[1].score == by[2].score and not by[1].predicted and not by[4].predicted
    assert by[5].predicted and by[6].predicted and by[None].predicted
    left = clean_documents(spark, docs, model)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4]
    assert score_toxicity(docs.limit(0), model).collect() == []
    assert train_model(spark, spark.createDataFrame([(1, "a", 1), (2, None, 0)], SCHEMA)) is None
    assert {r.score for r in score_toxicity(docs, None).collect()} == {0.0}


def shuffle_files(spark):
    """Name and size of the shuffle files of this local session."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name: os.path.getsize(os.path.join(top, name)) for d in dirs for top, _, names in os.walk(d)
            for name in names if name.startswith("shuffle_") and name.endswith(".data")}


class Sampled(Exception):
    """Ends training once the sample is drawn."""


@pytest.fixture()
def sample_of(monkeypatch):
    """sample_of(train): the rows that ``train()`` draws as its sample."""
    def stop(sample):
        raise Sampled(sample.collect())

    def run(train):
        monkeypatch.setattr(toxicity, "bucket_leaders", stop)
        with pytest.raises(Sampled) as drawn:
            train()
        return drawn.value.args[0]
    return run


def test_sampling_shuffles_no_texts_but_the_sample(spark, scratch, monkeypatch, sample_of):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("#$%&()*+,-/0123456789:;<=>@[]^_{}~"), 5000)) for _ in range(600)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(
        f"{scratch}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int").write.parquet(
        f"{scratch}/labels.parquet")
    monkeypatch.setattr(toxicity, "train_model", partial(train_model, cfg=ToxicConfig(sample_docs=20)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many labels
    try:
        before = shuffle_files(spark)
        rows = sample_of(lambda: toxic_model(spark, scratch))
        made = [n for name, n in shuffle_files(spark).items() if name not in before]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 40 and all(r.text == texts[r.doc_id] and r.toxic == (r.doc_id % 10 == 0) for r in rows)
    assert 0 < sum(made) < sum(map(len, texts)) / 4


def test_labels_in_their_own_table(spark, frame, sample_of):
    texts = [(i, f"text {i}") for i in range(12)] + [(2, "text 2"), (20, "text 3"), (1, "text 9")]
    texts += [(None, "no id"), (13, None), (14, "no label"), (15, "null label")]
    labels = [(i, int(i % 3 == 0)) for i in range(12)] + [(20, 0), (0, 1), (5, 1), (7, 2), (15, None), (13, 1), (40, 1)]
    docs, marks = frame(texts, "doc_id long, text string"), frame([*labels, (None, 1)], "doc_id long, toxic int")
    pairs = sorted((d, y, t) for d, t in texts for e, y in labels if d == e and None not in (d, t, y) and y < 2)
    first = {}
    for d, y, t in pairs:  # copies of a text teach once, by their smallest id
        first.setdefault(t, (d, y))
    got = [sample_of(lambda: train_model(spark, docs, labels=marks)),
           sample_of(lambda: train_model(spark, docs.join(marks, "doc_id")))]
    for rows in got:
        assert len({r.doc_id for r in rows}) == len(rows) == len({d for d, _ in first.values()})
        assert all(first[r.text] == (r.doc_id, r.toxic) for r in rows)


def test_query_on_held_out_ids(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    held = [(rows[d].score, y) for d, y in labels.items() if rows[d].held_out]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.8
    assert np.mean([r.predicted for d, r in rows.items() if labels.get(d) == 0]) < 0.03
