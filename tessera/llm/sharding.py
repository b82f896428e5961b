"""Sharding by a Hilbert curve over quantised metadata: rows sorted by curve
index and cut into runs of near-equal bytes, for multidimensional pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import Stash

DIMENSIONS = ("source", "lang", "length")


@dataclass(frozen=True)
class ShardConfig:
    """``bits`` a dimension; the curve has 2^(3 * bits) cells."""

    shards: int = 8
    bits: int = 5


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (n x d, each below 2^bits) on the Hilbert
    curve: axes are turned into the transposed index (Skilling, 2004), whose
    bits are then interleaved."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _curve_udf(bits: int):
    @pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), bits))
    return curve


def _ordered(column: str) -> F.Column:
    """The whole value behind a mark, so that null comes first and joins."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _measures(df: DataFrame) -> DataFrame:
    """One orderable value for each dimension."""
    return (df.withColumn("m_source", _ordered("m_src")).withColumn("m_lang", _ordered("m_lng"))
            .withColumn("m_length", F.floor(8 * F.log2(F.col("size"))).cast("long")))


def _equal_depth(df: DataFrame, dim: str, bits: int, stash: Stash) -> DataFrame:
    """(m_dim, x_dim): each distinct value's bin among 2^bits bins of
    near-equal row counts.  One row for each distinct value; ranks come from
    range partitions and the row counts before each."""
    value = f"m_{dim}"
    held = stash.keep(df.groupBy(value).agg(F.count("*").alias("n")).repartitionByRange(value)
                      .sortWithinPartitions(value).withColumn("piece", F.spark_partition_id()))
    total, before = 0, [F.lit(-1), F.lit(0)]
    for piece, n in sorted(held.groupBy("piece").agg(F.sum("n")).collect()):
        before += [F.lit(piece), F.lit(total)]
        total += n
    upto = Window.partitionBy("piece").orderBy(value)
    rank = F.sum("n").over(upto) - F.col("n") + F.create_map(*before)[F.col("piece")]
    return held.select(value, F.floor(rank * (1 << bits) / max(total, 1)).cast("long").alias(f"x_{dim}"))


def _cuts(groups: DataFrame, cfg: ShardConfig) -> list[tuple[int, str]]:
    """The ``shards`` - 1 keys (curve, text key) at which a new shard begins,
    nearest to equal bytes without splitting a group.

    Bytes are summed per cell, then only inside the cells that hold a cut per
    next three hex digits of the text key, until one group is left: each
    step returns at most 2^(3 bits) or 4096 rows a cut.
    """
    cells = sorted((r["curve"], r["bytes"]) for r in
                   groups.groupBy("curve").agg(F.sum("bytes").alias("bytes")).collect())
    total = sum(b for _, b in cells)
    goals = [total * k / cfg.shards for k in range(1, cfg.shards)]
    found: dict[float, tuple[int, str, int, int]] = {}  # goal -> (curve, key prefix, before, bytes)

    def place(goal: float, entries, before: int):
        for curve, prefix, size in entries:
            if before + size > goal:
                return curve, prefix, before, size
            before += size
        return None

    for goal in goals:
        if hit := place(goal, ((c, "", b) for c, b in cells), 0):
            found[goal] = hit
    digits = 0
    while digits < 32 and found:
        open_ = sorted({(c, p) for c, p, _, _ in found.values() if len(p) == digits})
        if not open_:
            break
        inside = None
        for c, p in open_:
            one = (F.col("curve") == c) & F.col("key").startswith(p)
            inside = one if inside is None else inside | one
        rows = (groups.where(inside).groupBy("curve", F.substring("key", 1, digits + 3).alias("prefix"))
                .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("one"))
                .collect())
        table: dict[tuple[int, str], list] = {}
        for r in rows:  # a bucket of one group is final: its prefix is the whole key
            prefix = r["one"] if r["n"] == 1 else r["prefix"]
            table.setdefault((r["curve"], r["prefix"][:digits]), []).append((r["curve"], prefix, r["bytes"]))
        for goal, (c, p, before, _) in list(found.items()):
            if len(p) == digits:
                found[goal] = place(goal, sorted(table[c, p]), before)
        digits += 3
    cuts = []
    for goal in goals:
        if goal not in found:
            cuts.append((1 << 62, ""))  # no bytes at all
            continue
        curve, key, before, size = found[goal]
        after = goal - before > before + size - goal
        cuts.append((curve, key + "~" if after else key))  # "~" sorts after hex digits
    return cuts


def shard_documents(spark: SparkSession, docs: DataFrame, cfg: ShardConfig = ShardConfig(),
                    carry: bool = False, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for
    every row, under the law of near-equal bytes.

    Source, language and length are quantised to equal-depth bins; rows are
    ordered by the Hilbert index of their bins, text key and doc_id and cut
    into runs.  Rows of equal texts form one group, placed by its smallest
    source and language and never split, so a shard's bytes are off by half
    of the group at its cut at most.  ``slot`` counts a shard's rows in curve
    order from 0.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty,
    null source or language sort first, a null id comes first in its group,
    repeated rows get slots one after the other, and an empty table gives an
    empty result.  With ``carry`` the input columns come back with shard,
    slot and curve instead.
    """
    stash = Stash(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"),
        F.col(source_col).alias("src"), F.col(lang_col).alias("lng"),
        *([F.struct("*").alias("row")] if carry else []))
    narrow = stash.keep(base.drop("row"))
    rows = base if carry else narrow

    span = lambda c: (F.min(c).alias(f"g_{c}"), F.min(c).eqNullSafe(F.max(c)).alias(f"one_{c}"),
                      F.count(c).alias(f"n_{c}"))
    mixed = (narrow.groupBy("key").agg(*span("src"), *span("lng"), F.count("*").alias("n"))
             .where("not one_src or not one_lng or n_src not in (0, n) or n_lng not in (0, n)")
             .select("key", "g_src", "g_lng", F.lit(True).alias("shared")))
    mixed = stash.keep(mixed)

    def measured(df: DataFrame) -> DataFrame:
        out = df.join(mixed, "key", "left")
        for name in ("src", "lng"):
            out = out.withColumn(f"m_{name}", F.when(F.col("shared"), F.col(f"g_{name}"))
                                 .otherwise(F.col(name)))
        return _measures(out)

    bins = {d: stash.keep(_equal_depth(measured(narrow), d, cfg.bits, stash)) for d in DIMENSIONS}

    def on_curve(df: DataFrame) -> DataFrame:
        out = measured(df)
        for d in DIMENSIONS:
            out = out.join(bins[d], f"m_{d}")
        return out.withColumn("curve", _curve_udf(cfg.bits)(*[f"x_{d}" for d in DIMENSIONS]))

    keep = ["doc_id", "size", "text_crc32", "key", "curve", *(["row"] if carry else [])]
    if carry:
        placed = on_curve(rows).select(*keep)
        sized = on_curve(narrow)
    else:
        placed = sized = stash.keep(on_curve(rows).select(*keep))
    groups = stash.keep(sized.groupBy("curve", "key").agg(F.sum("size").alias("bytes")))
    shard = F.lit(0)
    for c, k in _cuts(groups, cfg):
        shard = shard + F.when((F.col("curve") > c) | ((F.col("curve") == c) & (F.col("key") >= k)), 1).otherwise(0)

    order = ["curve", "key", "doc_id"]  # the shard follows from the first two
    laid = stash.keep(placed.withColumn("shard", shard).repartitionByRange(*order)
                      .sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33).alias("piece")
    runs = laid.groupBy("shard", piece).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select(
        "shard", "piece", "first",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    out = (laid.withColumn("piece", piece).join(runs, ["shard", "piece"])
           .withColumn("slot", F.col("before") + F.col("at") - F.col("first")))
    if carry:
        return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], "shard", "slot", "curve")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, cfg: ShardConfig = ShardConfig(),
                 files_per_shard: int = 8) -> DataFrame:
    """Write ``docs`` as Parquet, one folder a shard, its rows in curve order
    cut into files; a file then covers a small box of source, language and
    length, so filters on any of them skip most files.  Returns the table."""
    placed = shard_documents(spark, docs, cfg, carry=True)
    n = cfg.shards * files_per_shard
    (placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    return spark.read.parquet(path)
