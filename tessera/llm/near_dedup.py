"""Near-duplicate documents: one-permutation MinHash, banded buckets, star
candidates, exact confirmation on full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, Stash, chunks, mix, span_hashes, text_buffer, words
from tessera.llm.components import connected_components


@dataclass(frozen=True)
class NearDupConfig:
    """``shingle``: words a shingle.  ``percent``: least Jaccard similarity in
    per cent.  ``bands`` x ``rows`` bins: at similarity 0.8 a pair shares a
    bucket with probability 1 - (1 - 0.8^6)^40 > 0.99999."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6

    @property
    def bins(self) -> int:
        return self.bands * self.rows


# --- shingle sets and signatures (inside tasks) ------------------------------

def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted by row and hash.

    A-Z are lower-cased; words are runs of non-white bytes; a text with fewer
    than ``k`` words has its whole word sequence as one shingle; a text
    without words has none.
    """
    starts, ends, rows = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = span_hashes(LOWER[data], starts, ends)
    n = len(word)
    first = np.searchsorted(rows, rows, "left")
    count = np.searchsorted(rows, rows, "right") - first
    position = np.arange(n) - first
    width = np.minimum(count, k)
    opens = np.flatnonzero(position <= count - width)
    code = width[opens].astype(np.uint64)
    for j in range(k):
        has = width[opens] > j
        nxt = word[np.minimum(opens + j, n - 1)]
        code = np.where(has, mix(code ^ nxt, j + 1), code)
    owner = rows[opens]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[new], code[new]


_choices: dict[int, np.ndarray] = {}


def _donors(bins: int) -> np.ndarray:
    """For every bin a fixed pseudo-random order in which it asks others."""
    if bins not in _choices:
        _choices[bins] = np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=1)
    return _choices[bins]


def signatures(owner: np.ndarray, code: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """One-permutation MinHash, n_rows x bins: one hash of every element picks
    its bin (top bits) and its rank in it.  An empty bin copies the first
    non-empty bin in its own pseudo-random order (optimal densification).
    Rows without elements stay zero."""
    sig = np.zeros((n_rows, bins), dtype=np.uint64)
    if len(code) == 0:
        return sig
    ranked = mix(code, 977)
    order = np.lexsort((ranked, owner))
    owner, ranked = owner[order], ranked[order]
    bin_of = ((ranked >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(ranked), dtype=bool)
    lead[1:] = (owner[1:] != owner[:-1]) | (bin_of[1:] != bin_of[:-1])
    full = np.zeros((n_rows, bins), dtype=bool)
    sig[owner[lead], bin_of[lead]] = ranked[lead]
    full[owner[lead], bin_of[lead]] = True
    row, gap = np.nonzero(~full & full.any(axis=1)[:, None])
    donors = _donors(bins)
    for attempt in range(bins):
        if len(row) == 0:
            break
        ask = donors[gap, attempt]
        got = full[row, ask]
        sig[row[got], gap[got]] = sig[row[got], ask[got]]
        row, gap = row[~got], gap[~got]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for every band; the key holds the band's number."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        key = mix(key ^ parts[:, :, j], 31 + j)
    return key


_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType()))])
_SETS = T.StructType([
    T.StructField("rep", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])


def _list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    off = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _sign(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                n = part.num_rows
                owner, code = shingle_sets(*text_buffer(part.column(1)), cfg.shingle)
                sizes = np.bincount(owner, minlength=n)
                sums = []
                for seed in (501, 502):  # order-free 128-bit hash of the set
                    total = np.zeros(n, dtype=np.uint64)
                    np.add.at(total, owner, mix(code, seed))
                    sums.append(pa.array(total.view(np.int64)))
                some = np.flatnonzero(sizes > 0)
                keys = np.zeros((0, cfg.bands), np.uint64)
                if len(some):
                    sig = signatures(np.searchsorted(some, owner), code, len(some), cfg.bins)
                    keys = band_keys(sig, cfg.bands, cfg.rows)
                bands = _list_array(keys.reshape(-1), np.where(sizes > 0, cfg.bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), *sums, bands],
                    names=_SIGNED.fieldNames())
    return run


def _full_sets(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                owner, code = shingle_sets(*text_buffer(part.column(1)), cfg.shingle)
                sizes = np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _list_array(code, sizes)], names=_SETS.fieldNames())
    return run


# --- the operator ------------------------------------------------------------

def near_duplicates(spark: SparkSession, docs: DataFrame, cfg: NearDupConfig = NearDupConfig(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts with the same shingle set form one class.  Class representatives
    meet in buckets (one per band); in every bucket the member that meets
    most others is the centre of a star of candidate pairs, so a bucket of m
    members gives m - 1 pairs.  Pairs are confirmed on the full sets.  Buckets
    that their star leaves in several components are gathered in families
    around the centre met most often; an exact bound on the differences from
    it gives the pairs that may still be linked (``_across``), so every pair
    that shares a bucket ends up confirmed, refuted or already connected.

    Null or empty texts and texts of white space have n_shingles 0 and are
    linked with nothing.  A null id is linked with nothing: component_id is
    null and kept true.  Repeated rows get equal results.  An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    stash = Stash(spark, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stash.keep(texts.mapInArrow(_sign(cfg), _SIGNED))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stash.keep(
        usable.groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # one row for each class: its representative's bands
    reps = (usable.select("doc_id", "set_a", "set_b", "n_shingles", "bands")
            .join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")),
                  ["set_a", "set_b", "doc_id"], "left_semi")
            .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands"))
    entries = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stash.keep(entries.join(full, "bucket"))

    weight = stash.keep(members.groupBy("rep").agg(F.sum("size").alias("weight")))
    centres = stash.keep(
        members.join(weight, "rep").groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"), "n")).alias("top"))
        .select("bucket", (-F.col("top.low")).alias("centre"), F.col("top.n").alias("cn"),
                F.col("top.weight").alias("weight")))
    star = _fit_sizes(members.join(centres, "bucket").where("rep <> centre"), "n", "cn", cfg)
    tried = stash.keep(_similarity(texts, _pairs(star, "rep", "centre"), cfg))
    linked = tried.where("linked").select("a", "b")
    comps = connected_components(spark, linked, stash)

    # buckets that a star left in several components gather around one root
    met = tried.where("2 * common >= total")
    met = met.select(F.col("a").alias("centre"), F.col("b").alias("root")).unionByName(
        met.select(F.col("b").alias("centre"), F.col("a").alias("root")))
    heads = centres.select("centre", "weight").distinct()
    roots = (met.join(heads.select("centre"), "centre", "left_semi")
             .join(heads.select(F.col("centre").alias("root"), F.col("weight").alias("rw")), "root")
             .join(heads, "centre").where("rw > weight or (rw = weight and root < centre)")
             .groupBy("centre").agg(F.max(F.struct("rw", (-F.col("root")).alias("low"))).alias("top"))
             .select("centre", (-F.col("top.low")).alias("root")))
    open_ = _open_buckets(members, comps).join(centres.select("bucket", "centre"), "bucket").join(
        roots, "centre", "left")
    family = stash.keep(open_.select(F.coalesce("root", "centre").alias("root"), "rep", "n").distinct())
    if not family.isEmpty():
        again = _pairs(family.where("rep <> root"), "rep", "root").join(tried, ["a", "b"], "left_anti")
        second = stash.keep(_similarity(texts, again, cfg).where("linked").select("a", "b"))
        comps = _extend(spark, comps, second, stash)
        third = stash.keep(_similarity(texts, _across(texts, family, comps, cfg, stash), cfg)
                           .where("linked").select("a", "b"))
        comps = _extend(spark, comps, third, stash)

    named = (classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .where("copies > 1 or component is not null")
             .select("set_a", "set_b", "n_shingles",
                     F.coalesce("component", "rep").alias("component")))
    out = (signed.select("doc_id", "n_shingles", "set_a", "set_b")
           .join(named, ["set_a", "set_b", "n_shingles"], "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                              F.coalesce("component", "doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def bucket_leaders(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(doc_id) of the documents that share no bucket with one of a smaller
    id: a quick thinning of near copies for samples, without confirmation.
    Documents without words lead themselves; null ids are left out."""
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null") \
        .mapInArrow(_sign(cfg), _SIGNED)
    bands = F.when(F.size("bands") > 0, F.col("bands")).otherwise(F.array(-F.col("doc_id") - 1))
    entries = signed.select("doc_id", F.explode(bands).alias("bucket"))
    lead = entries.groupBy("bucket").agg(F.min("doc_id").alias("lead"))
    return (entries.join(lead, "bucket").groupBy("doc_id").agg(F.min("lead").alias("lead"))
            .where("lead = doc_id").select("doc_id"))


def _fit_sizes(pairs: DataFrame, x: str, y: str, cfg: NearDupConfig) -> DataFrame:
    """Only pairs whose set sizes allow the similarity (an exact bound)."""
    return pairs.where(100 * F.least(x, y) >= cfg.percent * F.greatest(x, y))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _extend(spark: SparkSession, comps: DataFrame, links: DataFrame, stash: Stash) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return comps
    known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    new = links.join(known.withColumnRenamed("b", "ca"), "a", "left").join(
        known.select(F.col("a").alias("b"), F.col("b").alias("cb")), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = connected_components(spark, new, stash)
    moved = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    merged = comps.join(moved, "component", "left").select(
        "node", F.coalesce("top", "component").alias("component"))
    fresh = top.join(comps.select("node"), "node", "left_anti").select("node", "component")
    return stash.keep(merged.unionByName(fresh))


def _sets(texts: DataFrame, asked: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(rep, hashes) of the documents named in ``asked`` (doc_id)."""
    return (texts.join(asked, "doc_id", "left_semi").mapInArrow(_full_sets(cfg), _SETS)
            .groupBy("rep").agg(F.min("hashes").alias("hashes")))


def _similarity(texts: DataFrame, pairs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b, common, total, linked): sizes of the intersection and union of
    the full shingle sets, and whether they reach the similarity."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _sets(texts, asked, cfg)
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .withColumn("common", F.size(F.array_intersect("ha", "hb")))
            .withColumn("total", F.size("ha") + F.size("hb") - F.col("common"))
            .select("a", "b", "common", "total",
                    (100 * F.col("common") >= cfg.percent * F.col("total")).alias("linked")))


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    return (members.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("comp", F.coalesce("component", "rep")).drop("component"))


def _open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets of three or more that hold several components."""
    placed = _placed(members.where("size > 2"), comps)
    split = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return placed.join(split.where("lo <> hi").select("bucket"), "bucket", "left_semi")


def _across(texts: DataFrame, family: DataFrame, comps: DataFrame, cfg: NearDupConfig,
            stash: Stash) -> DataFrame:
    """Candidate pairs (a, b) of one family (root, rep) that lie in different
    components, without forming all pairs.

    Members are written as differences from their root: D = set ^ root.  Two
    sets differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, and the similarity
    allows q (|x| + |y|) with q = (100 - percent) / (100 + percent), so a
    link needs k = (|Dx| - q |x| + |Dy| - q |y|) / 2 common differences.
    Differences that only one member has are no help; the others are ordered
    from rare to frequent, and a pair is a candidate where a common one comes
    early enough in both lists for k to be reached.  That bound is exact, and
    k > 0 because every member has been compared with its root.
    """
    q = (100 - cfg.percent) / (100 + cfg.percent)
    placed = _placed(family, comps)
    held = placed.groupBy("root", "comp").agg(F.count("*").alias("held"))
    main = held.groupBy("root").agg(F.max(F.struct("held", "comp")).alias("top"), F.count("*").alias("parts"))
    placed = placed.join(main.where("parts > 1").select("root", F.col("top.comp").alias("main")), "root")
    placed = stash.keep(placed)
    asked = placed.select(F.explode(F.array("root", "rep")).alias("doc_id")).distinct()
    sets = stash.keep(_sets(texts, asked, cfg))
    both = (placed.join(sets, "rep").withColumnRenamed("hashes", "mine")
            .join(sets.select(F.col("rep").alias("root"), F.col("hashes").alias("theirs")), "root"))
    differ = both.select(
        "root", "rep", "n", "comp", "main",
        F.concat(F.array_except("mine", "theirs"), F.array_except("theirs", "mine")).alias("d"))
    items = stash.keep(differ.withColumn("need", F.size("d") - q * F.col("n"))
                       .select("root", "rep", "n", "comp", "main", "need", F.explode("d").alias("e")))
    often = items.groupBy("root", "e").agg(F.count("*").alias("often")).where("often > 1")
    ranked = items.join(often, ["root", "e"])
    mine = Window.partitionBy("root", "rep")
    ranked = stash.keep(
        ranked.withColumn("left", F.count("*").over(mine)
                          - F.row_number().over(mine.orderBy("often", "e")) + 1)
        .drop("often"))
    x = ranked.where("comp <> main").select(
        "root", "e", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "comp", "need", "left")])
    pairs = x.join(ranked, ["root", "e"]).where(
        (F.col("x_comp") != F.col("comp"))
        & (F.least("x_left", "left") >= (F.col("x_need") + F.col("need")) / 2 - 1e-9)
        & (100 * F.least("x_n", "n") >= cfg.percent * F.greatest("x_n", "n")))
    return _pairs(pairs, "x_rep", "rep")
