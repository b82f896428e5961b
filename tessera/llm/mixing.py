"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token
blocks, integer quotas per source and shard, seeded block selection."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Stash

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in code-point order (null last).
    The mix is ``percent`` per cent of all words; a source gives at most
    ``repeat`` times its words.  ``block``: words a block; ``shards``: output
    shards the quotas are split over."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    repeat: int = 2
    block: int = 32
    shards: int = 8
    seed: int = 17


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    target: float
    blocks: int
    quota: int  # blocks the mix takes, repeats counted
    stride: int
    shift: int
    shard_quota: tuple[int, ...]


# --- apportionment (one entry for each source) --------------------------------

def capped_targets(sizes: list[int], weights: list[int], percent: int, repeat: int) -> list[float]:
    """Shares of ``percent`` % of all words by weight; a share above ``repeat``
    times its source's size stops there and the excess is shared again."""
    left = percent * sum(sizes) / 100
    targets = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight >= repeat * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(repeat * sizes[i])
        left -= sum(repeat * sizes[i] for i in over)
        open_ -= over
    return targets


def sainte_lague(votes: list[float], seats: int, limits: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k - 1), ties to the earlier
    entry, no entry above its limit.  Starts from the rounded shares, which
    are themselves such an allocation, and adds or takes single seats."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [min(m, math.floor(v * seats / total + 0.5)) for v, m in zip(votes, limits)]
    quotient = lambda i, k: votes[i] / (2 * k - 1)  # noqa: E731  of i's k-th seat
    more = [(-quotient(i, got[i] + 1), i) for i in range(len(votes)) if got[i] < limits[i]]
    heapq.heapify(more)
    missing = seats - sum(got)
    while missing > 0 and more:
        q, i = heapq.heappop(more)
        if q == 0:
            break
        got[i] += 1
        missing -= 1
        if got[i] < limits[i]:
            heapq.heappush(more, (-quotient(i, got[i] + 1), i))
    less = [(quotient(i, got[i]), -i) for i in range(len(votes)) if got[i] > 0]
    heapq.heapify(less)
    while missing < 0 and less:
        _, i = heapq.heappop(less)
        got[-i] -= 1
        missing += 1
        if got[-i] > 0:
            heapq.heappush(less, (quotient(-i, got[-i]), i))
    return got


def plan_sources(totals: list[tuple[str | None, int]], cfg: MixConfig) -> list[SourcePlan]:
    """The plan of every source, in code-point order with null last."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    weights = [cfg.weights[i % len(cfg.weights)] for i in range(len(totals))]
    targets = capped_targets(sizes, weights, cfg.percent, cfg.repeat)
    blocks = [-(-n // cfg.block) for n in sizes]
    seats = math.floor(sum(targets) / cfg.block + 0.5)
    quotas = sainte_lague(targets, seats, [cfg.repeat * b for b in blocks])
    plans, before = [], 0
    for (source, size), target, n, quota in zip(totals, targets, blocks, quotas):
        label = "n" if source is None else f"s{source}"
        digest = hashlib.md5(f"{cfg.seed}:{label}".encode()).hexdigest()
        stride, shift = 1, 0
        if n > 1:
            stride = 1 + int(digest[:8], 16) % min(n, 1 << 20)
            while math.gcd(stride, n) != 1:
                stride += 1
            shift = int(digest[8:16], 16) % n
        # the source's seats are before .. before + quota - 1; seat j goes to shard j mod shards
        held = tuple(-(-(before + quota - s) // cfg.shards) - -(-(before - s) // cfg.shards)
                     for s in range(cfg.shards))
        plans.append(SourcePlan(source, size, target, n, quota, stride, shift, held))
        before += quota
    return plans


_PLAN = T.StructType([
    T.StructField("p_source", T.StringType()), T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()), T.StructField("p_blocks", T.LongType()),
    T.StructField("p_base", T.LongType()), T.StructField("p_rest", T.LongType()),
    T.StructField("p_stride", T.LongType()), T.StructField("p_shift", T.LongType())])


# --- the operator -------------------------------------------------------------

def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def allocate(spark: SparkSession, docs: DataFrame, cfg: MixConfig = MixConfig(), carry: bool = False,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             ) -> tuple[DataFrame, list[SourcePlan]]:
    """Rows (doc_id, size, source_size, target, taken, start, copies plan) and
    the plan of every source.

    A source's documents are laid end to end in seeded order and cut into
    blocks of ``cfg.block`` words.  Its quota of q blocks over n takes every
    block q div n times and q mod n of them once more: those whose seeded
    position (stride * block + shift) mod n is below q mod n.  ``taken`` is
    the words of the document in taken blocks, repeats counted; ``start`` is
    its offset in the source.  The plan collects one (source, words) pair a
    source.

    Null or empty texts have size and taken 0; rows of a null source form one
    source; a source without words has target 0; repeated rows are laid out
    one after the other.  With ``carry`` the input row stays in struct
    column ``row``.
    """
    stash = Stash(spark, "mix")
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), F.col(id_col).cast("string"))).alias("spot"),
        F.xxhash64(text_col).alias("tie"),
        *([F.struct("*").alias("row")] if carry else []))
    narrow = stash.keep(base.select("source", "size", "spot") if carry else base)
    if not carry:
        base = narrow
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    plans = plan_sources([(r["source"], r["size"]) for r in totals], cfg)
    rows = sum(r["rows"] for r in totals)
    digits = max(1, math.ceil(math.log(max(rows, 1) / 20_000 + 1, 16)))  # about 20,000 rows a bucket

    part = F.substring("spot", 1, digits).alias("part")
    sums = (narrow.groupBy(F.col("source").alias("b_source"), part).agg(F.sum("size").alias("held"))
            .withColumn("before", F.sum("held").over(
                Window.partitionBy("b_source").orderBy("part")) - F.col("held"))
            .select("b_source", F.col("part").alias("b_part"), "before"))
    ahead = Window.partitionBy("source", "part").orderBy("spot", "doc_id", "tie") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("part", part).withColumn(
        "inside", F.sum("size").over(ahead) - F.col("size"))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("b_source"))
                         & F.col("part").eqNullSafe(F.col("b_part")))
    table = spark.createDataFrame(
        [(p.source, p.size, p.target, p.blocks, p.quota // max(p.blocks, 1), p.quota % max(p.blocks, 1),
          p.stride, p.shift) for p in plans], _PLAN)
    placed = (placed.join(table, F.col("source").eqNullSafe(F.col("p_source")))
              .withColumn("start", F.col("before") + F.col("inside")))
    size = F.lit(cfg.block)
    lo, hi = F.col("start"), F.col("start") + F.col("size")
    extra = F.aggregate(
        F.sequence(F.floor(lo / size), F.floor((hi - 1) / size)), F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(
            _extra(b), F.least((b + 1) * size, hi) - F.greatest(b * size, lo)).otherwise(0))
    placed = placed.withColumn("taken", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(
        F.col("p_base") * F.col("size") + extra))
    return placed, plans


def _extra(block) -> F.Column:
    """Whether a block is taken once more than its source's other blocks."""
    return F.pmod(F.col("p_stride") * block + F.col("p_shift"), F.col("p_blocks")) < F.col("p_rest")


def mix_sources(spark: SparkSession, docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; see ``allocate``."""
    placed, _ = allocate(spark, docs, cfg)
    return placed.select("doc_id", "size", "source_size", "target", "taken")


_FIND = regex.compile(WORD)


def mixed_documents(spark: SparkSession, docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: for every document and
    pass (1 to ``cfg.repeat``) that takes any of its words a row whose text
    holds the taken words.  A document taken whole keeps its text as it is;
    otherwise the runs of taken words keep the white space inside them and
    are joined by a newline.  ``n_chars``, where present, follows the text.
    Documents without words take no part in a mix of words.
    """
    placed, _ = allocate(spark, docs, cfg, carry=True)
    block = cfg.block
    cut = F.when(F.col("p_rest") > 0, F.filter(
        F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)),
        _extra))
    wanted = (placed.where("taken > 0")
              .select("row", "size", "start", F.col("p_base").alias("whole"),
                      F.coalesce(cut, F.array().cast("array<long>")).alias("cut")))
    wanted = wanted.withColumn("part_size", F.lit(0).cast("long"))
    names = docs.columns
    whole = (wanted.where("whole > 0")
             .select("row.*", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("_pass")).select(*names))
    extra = wanted.where(F.size("cut") > 0)
    out = docs.schema
    at = names.index("text")
    texts = extra.select(*[F.col("row")[c].alias(c) for c in names],
                         F.col("start").alias("_start"), F.col("cut").alias("_cut"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, start, cut in zip(*(batch.column(i).to_pylist() for i in (at, -2, -1))):
                new.append(_slice(text, start, cut, block))
            cols = list(batch.columns[:len(names)])
            cols[at] = pa.array(new, type=cols[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(t) for t in new]).cast(cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return whole.unionByName(texts.mapInArrow(pieces, out))


def _slice(text: str, start: int, cut: list[int], block: int) -> str:
    """The words of ``text`` (the first is word ``start`` of its source) that
    lie in the blocks ``cut``; the text itself if that is all of them."""
    spans = [m.span() for m in _FIND.finditer(text)]
    runs: list[list[int]] = []
    for b in sorted(cut):
        lo, hi = max(b * block - start, 0), min((b + 1) * block - start, len(spans))
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[lo][0]:spans[hi - 1][1]] for lo, hi in runs)


def oracle_sql(cfg: MixConfig = MixConfig()) -> str:
    """DuckDB SQL for ``mix_sources`` over ``documents``."""
    weights = ", ".join(str(w) for w in cfg.weights)
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{cfg.seed}:' || doc_id) AS spot FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
s1 AS (SELECT source, n, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos FROM s0),
s2 AS (SELECT *, [{weights}][1 + (pos - 1) % {len(cfg.weights)}] AS w, sum(n) OVER () AS allw FROM s1),
s3 AS (SELECT *, {cfg.repeat} * n AS cap, row_number() OVER (ORDER BY {cfg.repeat} * n / w, pos) AS k FROM s2),
s4 AS (SELECT *, sum(cap) OVER (ORDER BY k) AS capsum, sum(w) OVER () - sum(w) OVER (ORDER BY k) AS wleft,
              lead({cfg.repeat} * n / w) OVER (ORDER BY k) AS nxt FROM s3),
lv AS (SELECT k, ({cfg.percent} * allw / 100 - capsum) AS lft, wleft, nxt FROM s4
       UNION ALL SELECT 0, {cfg.percent} * any_value(allw) / 100, sum(w), min(cap / w) FROM s4),
pick AS (SELECT * FROM lv WHERE nxt IS NULL OR lft / wleft < nxt ORDER BY k LIMIT 1),
t AS (SELECT source, n, pos, CASE WHEN s4.k <= pick.k THEN cap::DOUBLE ELSE lft * w / pick.wleft END::DOUBLE AS target,
             ((n + {cfg.block} - 1) // {cfg.block})::BIGINT AS blocks FROM s4, pick),
q AS (SELECT pos, i AS seat, row_number() OVER (ORDER BY target / (2 * i - 1) DESC, pos, i) AS rk
      FROM (SELECT pos, target, unnest(range(1, {cfg.repeat} * blocks + 1)) AS i FROM t)),
seats AS (SELECT floor(sum(target) / {cfg.block} + 0.5) AS n FROM t),
quota AS (SELECT pos, count(*) AS quota FROM q, seats WHERE rk <= seats.n GROUP BY pos),
p0 AS (SELECT t.*, coalesce(quota, 0) AS quota, md5('{cfg.seed}:' || coalesce('s' || source, 'n')) AS h
       FROM t LEFT JOIN quota USING (pos)),
p1 AS (SELECT *, 1 + ('0x' || substr(h, 1, 8))::BIGINT % least(greatest(blocks, 1), {1 << 20}) AS s0,
              ('0x' || substr(h, 9, 8))::BIGINT % greatest(blocks, 1) AS shift FROM p0),
g AS (SELECT pos, min(x) AS stride FROM (SELECT pos, blocks, unnest(range(s0, s0 + 1000)) AS x FROM p1)
      WHERE gcd(x, greatest(blocks, 1)) = 1 GROUP BY pos),
p AS (SELECT * FROM p1 JOIN g USING (pos)),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id) - size AS start FROM d),
j AS (SELECT o.*, p.n, p.target, p.blocks, p.quota, p.stride, p.shift FROM o JOIN p
      ON o.source IS NOT DISTINCT FROM p.source),
e AS (SELECT doc_id, sum(least((b + 1) * {cfg.block}, start + size) - greatest(b * {cfg.block}, start)) AS extra
      FROM (SELECT *, unnest(range((start // {cfg.block})::BIGINT, ((start + size - 1) // {cfg.block})::BIGINT + 1)) AS b
            FROM j WHERE size > 0)
      WHERE (stride * b + shift) % blocks < quota % blocks GROUP BY doc_id)
SELECT j.doc_id, size, n AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (quota // blocks) * size + coalesce(extra, 0) END)::BIGINT AS taken
FROM j LEFT JOIN e USING (doc_id)"""
