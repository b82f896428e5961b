import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling as sp
from tessera.llm.common import Stash, text_buffer
from tessera.llm.queries import op12_spelling

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, cfg):
    count = collections.Counter()
    for doc_id, text in rows:
        for r in RUN.findall(text or ""):
            r = r.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if cfg.drop and h % cfg.drop == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            count[r] += 1
    return {w: n for w, n in count.items() if len(w) >= cfg.shortest and n >= cfg.least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count, cfg):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= cfg.times * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def texts(seed, letters, shortest, n=60):
    """Texts of words that crowd together: few stems, edited at random."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + 4))) for _ in range(25)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(stems[:int(rng.random() ** 2 * 25) + 1])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:],
                                w[:k] + rng.choice(letters) + w[k + 1:]))
            out.append(rng.choice((w, w.upper(), w.title())))
        rows.append((i, rng.choice((" ", ", ", "\n", "漢", "1")).join(out)))
    return rows


@pytest.mark.parametrize("cfg", [sp.SpellingConfig(), sp.SpellingConfig(shortest=3, least=1, times=2, drop=7, page=64),
                                 sp.SpellingConfig(least=2, times=2, drop=0, block=40, page=32)])
def test_against_all_pairs(spark, cfg):
    for letters in ("abé", "abcdefgÀÿ÷"):
        rows = texts(cfg.page + len(letters), letters, cfg.shortest)
        want = brute(brute_words(rows, cfg), cfg)
        got = sp.spelling_variants(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), cfg)
        assert {tuple(r) for r in got.collect()} == want
        assert sum(r[1] is not None for r in want) > 3


def test_blocks_are_split_and_packed_without_losing_pairs(spark):
    rng = random.Random(5)
    words = sorted({"stem" + "".join(rng.choice("abcd") for _ in range(rng.choice((2, 3)))) for _ in range(400)})
    rows = [(w, rng.randint(1, 9)) for w in words]
    df = spark.createDataFrame(rows, "word string, n long")
    want = {w: sum(one_edit(w, v) for v in words) for w in words}
    for cfg in (sp.SpellingConfig(), sp.SpellingConfig(block=7, page=16), sp.SpellingConfig(page=4096)):
        got = {r.word: r.n_near for r in sp.near_words(df, Stash(spark, "spelling-test"), cfg).collect()}
        assert got == {w: k for w, k in want.items() if k}


def test_edges(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (None, ("letter " * 30 + "leter ") * 9), (4, (long + " ") * 8),
            (5, (long[:-1] + " ") * 50), (5, "ÀÉÎÕÜß " * 6), (6, "àéîõüß " * 6), (7, "naïve " * 40 + "naıve")]
    cfg = sp.SpellingConfig()
    got = sp.spelling_variants(spark, spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert {tuple(r) for r in got.collect()} == brute(brute_words(rows, cfg), cfg)
    twice = rows + rows[3:4]  # repeated rows count each
    got = sp.spelling_variants(spark, spark.createDataFrame(twice, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute(brute_words(twice, cfg), cfg)
    empty = spark.createDataFrame([], SCHEMA + ", word string, n int, tile int")
    assert sp.spelling_variants(spark, empty).collect() == []
    for wrong in (sp.SpellingConfig(shortest=2), sp.SpellingConfig(times=1)):
        with pytest.raises(ValueError):
            sp.spelling_variants(spark, empty, wrong)


def test_checksums_of_runs():
    words = ["a", "hello", "é" * 5, "x" * 64, "y" * 65, "z" * 5000, "mid" * 20]
    data, offsets = text_buffer(pa.array([" ".join(words)]))
    starts, ends, row = sp.letter_runs(data, offsets)
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    got = sp.run_checksums(data, starts, ends, seeds)
    assert got.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)] and set(row) == {0}


def test_query_over_the_table(spark, sf):
    cfg = sp.SpellingConfig()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in op12_spelling(spark, sf).collect()} == brute(brute_words(rows, cfg), cfg)
