import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex

from tessera.llm.common import text_buffer
from tessera.llm.langid import LangConfig, code_lengths, predict_language, train_model
from tessera.llm.queries import QUERIES


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)


def brute_bits(train, text, order):
    """Code length of ``text`` after counting ``train`` (lists of texts)."""
    def coded(t):
        for w in regex.findall(rb"[A-Za-z\x80-\xff]+", fold(t).encode()):
            s = b" " + w + b" "
            for i in range(1, len(s)):
                yield s[max(0, i - order):i], s[i]
    counts = defaultdict(Counter)
    for t in train:
        for context, byte in coded(t):
            for k in range(len(context) + 1):
                counts[context[len(context) - k:]][byte] += 1
    bits = 0.0
    for context, byte in coded(text):
        for k in range(len(context), -1, -1):
            seen = counts.get(context[len(context) - k:])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(frame, spark):
    rows = [(1, "The thin cat sat on the mat, thinking.", "en"), (2, "There ÉTÉ then", "en"),
            (3, "le chat était là où il était été", "fr"), (4, "chaque chien", "fr")]
    model = train_model(frame(rows, "doc_id long, text string, lang string"), LangConfig(sample_bytes=10**6))
    assert model.languages == ["en", "fr"]
    texts = ["the cat", "le chien ÉTAIT là", "xyz qqq 123", "Ünknown — words", "", "..."]
    got = code_lengths(*text_buffer(pa.array(texts)), model)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            want = brute_bits([r[1] for r in rows if r[2] == lang], t, 4)
            assert abs(got[i, j] - want) < 1e-3 * max(1, want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op7_language"](spark, sf).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(langs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [rows[d].lang_pred == langs[d] for d in rows if rows[d].held_out]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_edge_cases(frame, spark):
    rows = [(i, w * 20, lang) for i, (w, lang) in enumerate([("the and ", "en"), ("der und ", "de")] * 5)]
    model = train_model(frame(rows + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string"))
    odd = [(1, None), (2, ""), (3, "12 + 3 — “”"), (4, "the"), (5, "привет"), (6, "und der " * 60_000), (None, "the"),
           (7, "the"), (7, "the")]
    got = predict_language(spark, frame([(*r, 1) for r in odd], "doc_id long, text string, score int"), model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(odd)
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == by[7][0] == by[None][0] == "en" and by[6][0] == "de" and by[5][0] in ("en", "de")
    none = train_model(frame(rows, "doc_id long, text string, lang string").where("lang is null"))
    assert {r.lang_pred for r in predict_language(spark, frame(rows, "doc_id long, text string, lang string"), none).collect()} == {"und"}


def test_languages_of_few_long_documents_are_kept(frame, spark):
    rows = [(10 * k + i, f"lang{k} word" * 30, f"l{k}") for k in range(12) for i in range(3)]
    model = train_model(frame(rows, "doc_id long, text string, lang string"), LangConfig(sample_bytes=100))
    assert model.languages == sorted(f"l{k}" for k in range(12))
