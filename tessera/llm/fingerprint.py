"""Document fingerprints: quartile bucket digests of hashed byte triplets and
length, compared with a bounded difference score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import CHUNK_BYTES, bounded_batches, text_buffer

BUCKETS = 128
#: Mean difference of two independent bodies: 1.25 quartiles a bucket.
BOUND = 1.25 * BUCKETS
PART_BYTES = 32 << 20


# --- digest and comparison -------------------------------------------------------

def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 3 + 128 small numbers for every text: length class, two
    quartile ratios, and each bucket's quartile.

    Every three consecutive bytes are hashed to one of 128 buckets.  With
    q1 <= q2 <= q3 the 32nd, 64th and 96th smallest counts, a bucket's
    quartile is how many of them its count exceeds; the ratios are q1 / q3
    and q2 / q3 in sixteenths; the length class is 8 log2(bytes + 1).  Texts
    of fewer than three bytes have no triplet and all quartiles 0.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((n, BUCKETS), dtype=np.int64)
    if len(data) > 2:
        code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(25)
        row = np.repeat(np.arange(n), sizes)[:-2]
        inside = np.arange(len(data) - 2) + 2 < offsets[1:][row]
        flat = row * BUCKETS + bucket
        counts = np.bincount(flat[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    out = np.zeros((n, 3 + BUCKETS), dtype=np.uint8)
    out[:, 0] = np.minimum(8 * np.log2(sizes + 1), 255)
    top = np.maximum(q3, 1)
    out[:, 1], out[:, 2] = 15 * q1 // top, 15 * q2 // top
    out[:, 3:] = sum((counts > q[:, None]).astype(np.uint8) for q in (q1, q2, q3))
    return out


def encode(rows: np.ndarray) -> list[str]:
    """Fingerprints as hex: length class, both ratios, then 2 bits a bucket."""
    body = rows[:, 3:].reshape(len(rows), -1, 4)
    packed = body[:, :, 0] << 6 | body[:, :, 1] << 4 | body[:, :, 2] << 2 | body[:, :, 3]
    head = np.stack([rows[:, 0], rows[:, 1] << 4 | rows[:, 2]], axis=1)
    return [r.tobytes().hex() for r in np.concatenate([head, packed], axis=1).astype(np.uint8)]


def decode(prints: list[str]) -> np.ndarray:
    raw = np.array([list(bytes.fromhex(p)) for p in prints], dtype=np.uint8)
    body = np.stack([raw[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), -1)
    return np.concatenate([raw[:, :1], raw[:, 1:2] >> 4, raw[:, 1:2] & 15, body], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - difference / bound, row by row, at least 0: the difference is the
    sum of the buckets' quartile differences, of the ratios' differences, and
    of the length classes' difference beyond 8 (a factor of two)."""
    apart = np.abs(a.astype(np.int32) - b.astype(np.int32))
    total = apart[:, 3:].sum(axis=1) + apart[:, 1] + apart[:, 2] + np.maximum(apart[:, 0] - 8, 0)
    return 1 - np.minimum(total, BOUND) / BOUND


def compare(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair."""
    return likeness(decode(a), decode(b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encode(digests(*text_buffer(batch.column(1)))), pa.string())],
                names=["doc_id", "fingerprint"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fingerprint string")


# --- documents against their edited texts and successors ---------------------------

_ROUTED = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("extra", T.BooleanType()),
    T.StructField("spot", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType())])
_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])
_FIRST = -(1 << 63)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (floor) replaced by as many first code
    points of ``following``, or all of it."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprint_edits(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row.

    The next document is the one that follows in descending doc_id; the first
    follows the last, a single document itself.  Ids are cut into ranges of
    near-equal rows; a range also gets the first document of the next one, so
    texts move once and no task sees more than its range.

    A null text counts as empty; null ids come after all others; of rows with
    one id the smaller text comes first; an empty table gives an empty
    result.  Other columns are not read.
    """
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = texts.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("spot"), F.octet_length("text").alias("size"))
    volume = ids.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                math.ceil((volume["bytes"] or 0) / PART_BYTES))
    parts = max(1, min(parts, volume["rows"]))
    edges = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        edges = sorted(set(ids.agg(F.percentile_approx("spot", shares, 20 * parts).alias("e")).first()["e"]))
    cuts = np.array(edges, dtype=np.int64)

    @F.pandas_udf("long")
    def part_of(spot):
        import pandas as pd
        return pd.Series(len(cuts) - np.searchsorted(cuts, spot.to_numpy(), "right"))
    tops = dict(ids.groupBy(part_of("spot").alias("part")).agg(F.max("spot").alias("top"))
                .toArrow().to_pandas().sort_values("part").itertuples(index=False, name=None))
    order = list(tops)  # the parts that have rows, in descending order of ids
    lends = {tops[order[(i + 1) % len(order)]]: p for i, p in enumerate(order)}
    asked = np.array(sorted(lends), dtype=np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(0).fill_null(_FIRST).to_numpy(zero_copy_only=False)
            part = len(cuts) - np.searchsorted(cuts, spot, "right")
            head = [pa.array(part, pa.int64()), pa.array(np.zeros(len(spot), bool)), pa.array(spot, pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, *batch.columns], names=_ROUTED.fieldNames())
            lent = np.flatnonzero(np.isin(spot, asked))
            if len(lent):
                to = [lends[int(s)] for s in spot[lent]]
                head = [pa.array(to, pa.int64()), pa.array(np.ones(len(lent), bool)), pa.array(spot[lent], pa.int64())]
                rows = batch.take(pa.array(lent))
                yield pa.RecordBatch.from_arrays([*head, *rows.columns], names=_ROUTED.fieldNames())

    laid = (texts.mapInArrow(route, _ROUTED).repartition(parts, "part")
            .sortWithinPartitions("part", "extra", F.desc("spot"), "text"))
    return laid.mapInArrow(_walk, _OUT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the text of the row after it in its part."""
    held: list[tuple[int, bool, int | None, str]] = []
    size = 0
    for batch in batches:
        part, extra, _, doc, text = (c.to_pylist() for c in batch.columns)
        for row in zip(part, extra, doc, text):
            held.append(row)
            size += len(row[3])
            if size > CHUNK_BYTES // 2 and len(held) > 1:
                yield from _measure(held)
                held, size = held[-1:], len(row[3])
    yield from _measure(held, last=True)


def _measure(rows: list[tuple[int, bool, int | None, str]], last: bool = False) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, whose successor is not known yet (at
    the end the last is lent by the next part and has none)."""
    own = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
    assert not last or not rows or rows[-1][1]
    if not own:
        return
    data = digests(*text_buffer(pa.array([a[3] for a, _ in own])))
    after = digests(*text_buffer(pa.array([b[3] for _, b in own])))
    edits = pa.array([edited_text(a[3], b[3]) for a, b in own])
    edited = digests(*text_buffer(edits))
    yield pa.RecordBatch.from_arrays([
        pa.array([a[2] for a, _ in own], pa.int64()), pa.array([len(a[3]) for a, _ in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits.to_pylist()]),
        pa.array(encode(data)), pa.array(encode(edited)),
        pa.array(likeness(data, edited)), pa.array(likeness(data, after))], names=_OUT.fieldNames())
