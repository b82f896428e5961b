"""Fill-in-middle: cuts at token ranks found by a piecewise-linear learned
index over the token boundaries of every text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WHITE, bounded_batches, chunks, text_buffer, words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_FRACTION = 20   # binary places of a slope
_LONGEST = 1 << 20  # ranks a segment at most, so that rounded slopes stay exact enough
_BIAS = 128      # residuals are stored as unsigned bytes


@dataclass(frozen=True)
class FillMiddleConfig:
    """``seed`` opens the hashed string of every document.  A document is
    rearranged if its third draw is below ``percent`` of 100, suffix first if
    its fourth is below ``suffix_first``.  ``error``: largest distance (code
    points) between a boundary and its segment's line, 100 at most."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    error: int = 48


# --- the index (inside tasks) ------------------------------------------------

def fit_segments(at: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, slope) of the segments over the increasing offsets ``at``.

    From its first point a segment runs on while some line through that point
    passes all others within ``error``: the admissible slopes are a cone that
    every further point narrows.  Slopes are integers in units of 2^-20.
    """
    first, slope = [], []
    i, n = 0, len(at)
    while i < n:
        low, high, j, step = 0.0, np.inf, i + 1, 64
        stop = min(n, i + _LONGEST)
        while j < stop:
            k = min(j + step, stop)
            run, rise = np.arange(j - i, k - i), at[j:k] - at[i]
            top = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            bottom = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            good = int(np.argmax(bottom > top)) if bottom[-1] > top[-1] else k - j
            if good:
                low, high = bottom[good - 1], top[good - 1]
            j += good
            if j < k:
                break
            step *= 2
        first.append(i)
        slope.append(round((low + high) / 2 * (1 << _FRACTION)) if j > i + 1 else 0)
        i = j
    return np.array(first, np.int64), np.array(slope, np.int64)


def predictions(first: np.ndarray, base: np.ndarray, slope: np.ndarray, n: int) -> np.ndarray:
    """The offsets that the segments predict for the ranks 0 to n - 1."""
    ranks = np.arange(n)
    seg = np.searchsorted(first, ranks, "right") - 1
    return base[seg] + (slope[seg] * (ranks - first[seg]) >> _FRACTION)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point offset of every token boundary, first boundary of each
    row).  Tokens are words with the white space before them, and white space
    at the end; a row of n tokens has n + 1 boundaries, the first is 0."""
    n_rows = len(offsets) - 1
    points = np.zeros(len(data) + 1, np.int64)  # code points before every byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    _, ends, rows = words(data, offsets)
    last = offsets[1:] - 1
    trailing = np.flatnonzero((np.diff(offsets) > 0) & WHITE[data[last]]) if len(data) else np.zeros(0, np.int64)
    place = np.concatenate([offsets[:-1], ends, offsets[1:][trailing]])
    owner = np.concatenate([np.arange(n_rows), rows, trailing])
    order = np.lexsort((place, owner))
    place, owner = place[order], owner[order]
    return points[place] - points[offsets[:-1]][owner], np.searchsorted(owner, np.arange(n_rows + 1))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts), kind))


_INDEX = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("first_rank", T.ArrayType(T.LongType())),
    T.StructField("first_offset", T.ArrayType(T.LongType())), T.StructField("slope", T.ArrayType(T.LongType())),
    T.StructField("residuals", T.BinaryType())])


def _index(cfg: FillMiddleConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                at, starts = boundaries(*text_buffer(part.column(1)))
                first, base, slope, rest = [], [], [], []
                for a, b in zip(starts[:-1], starts[1:]):
                    own = at[a:b]
                    f, s = fit_segments(own, cfg.error)
                    first.append(f)
                    base.append(own[f])
                    slope.append(s)
                    rest.append((own - predictions(f, own[f], s, len(own)) + _BIAS).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(starts) - 1),
                     *[_lists(x, pa.int64()) for x in (first, base, slope)], pa.array(rest, pa.binary())],
                    names=_INDEX.fieldNames())
    return run


# --- the operator ------------------------------------------------------------

def rank_index(spark: SparkSession, docs: DataFrame, cfg: FillMiddleConfig = FillMiddleConfig(),
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n, first_rank, first_offset, slope, residuals) for every
    row: the number of tokens, the segments of its index and one residual
    byte for each of its n + 1 boundaries.  A null text counts as empty."""
    if not 0 <= cfg.error <= 100:
        raise ValueError("error must lie between 0 and 100: a residual is one byte")
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_index(cfg), _INDEX)


def offset_at(rank: Column) -> Column:
    """The exact code point offset of boundary ``rank`` (0 to n) from the
    columns of ``rank_index``: the segment's prediction plus the residual."""
    seg = F.size(F.filter("first_rank", lambda r: r <= rank))
    run = F.element_at("slope", seg) * (rank - F.element_at("first_rank", seg))
    byte = F.substring(F.col("residuals"), (rank + 1).cast("int"), F.lit(1))
    residual = F.conv(F.hex(byte), 16, 10).cast("long") - _BIAS
    return F.element_at("first_offset", seg) + F.shiftright(run, _FRACTION) + residual


def fill_in_middle(spark: SparkSession, docs: DataFrame, cfg: FillMiddleConfig = FillMiddleConfig(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    Four draws come from the SHA-256 of ``seed:doc_id``.  Two choose the
    token ranks of the cuts, the others the form: plain (the text as it is),
    psm or spm.  Texts that are empty or contain a marker stay plain.

    A null text counts as empty, a null id as an empty string in the draws;
    rows with equal id and text give equal rows.  An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    a, b = draw[0] % (F.col("n") + 1), draw[1] % (F.col("n") + 1)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (draw[2] % 100 >= cfg.percent)
    form = F.when(plain, "plain").when(draw[3] % 100 < cfg.suffix_first, "spm").otherwise("psm")
    cut = rank_index(spark, docs, cfg, id_col, text_col).select(
        "doc_id", "text", "n", form.alias("form"),
        F.when(~plain, offset_at(F.least(a, b))).alias("prefix_chars"),
        F.when(~plain, offset_at(F.greatest(a, b))).alias("_end"))
    start, end = F.col("prefix_chars").cast("int"), F.col("_end").cast("int")
    prefix = F.substring("text", F.lit(1), start)
    middle = F.substring("text", start + 1, end - start)
    suffix = F.substring("text", end + 1, F.length("text"))
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix,
                                                     F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    return cut.select("doc_id", "n", "form", "prefix_chars",
                      (F.col("_end") - F.col("prefix_chars")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made.  No marker can arise across
    the parts, since a marker neither begins nor ends with part of another."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query ``op11_fill_middle``."""
    white, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return rf"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '{white}*{word}+|{white}+') AS t,
               sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM documents),
    drawn AS (
        SELECT *, len(t) AS n,
               ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM cut),
    parts AS (
        SELECT doc_id, n, form, text,
               array_to_string(t[1:least(a, b)], '') AS p,
               array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(t[greatest(a, b) + 1:], '') AS s
        FROM drawn)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts"""
