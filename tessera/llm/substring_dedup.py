"""Repeated passages: relative Lempel-Ziv parsing of every document against
the indexed blocks of all documents, exact at the factors' ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Stash, bounded_batches, chunks, mix, span_hashes, text_buffer, words


@dataclass(frozen=True)
class RepeatConfig:
    """``window``: words that make a repeated passage.  ``anchor``: words of
    the sequence at which blocks are cut; a block holds at most
    2 window - anchor words.  ``sample``: one in so many documents is looked at for
    anchors so frequent that their blocks are spread; ``frequent``: an anchor
    is one if it makes up more than 1 / frequent of the sampled ones, so there are
    at most ``frequent``.  ``cache``: blocks that a task remembers."""

    window: int = 20
    anchor: int = 10
    sample: int = 32
    frequent: int = 20_000
    cache: int = 1_000_000


# --- hashes of word sequences ------------------------------------------------

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def gram_hashes(word: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from every position (n - k + 1 values), put
    together from hashes of 1, 2, 4, ... words."""
    n = len(word)
    out, done, power, width = None, 0, mix(word, seed), 1
    while True:
        if k & width:
            part = power[done:n - k + done + 1] if n >= k else power[:0]
            out = part if out is None else mix(out * _STEP + part, width)
            done += width
        if 2 * width > k:
            return out[:max(0, n - k + 1)]
        power = mix(power[:-width] * _STEP + power[width:], width) if len(power) > width else power[:0]
        width *= 2


def range_hashes(word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word range, from prefix sums."""
    n = len(word)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _STEP)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _STEP_INV)]), dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(word, 7) * up[:n], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64), 11)


def leftmost_minimum(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum among the ``width`` values from every
    position (n - width + 1 positions)."""
    at, span = np.arange(len(value)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(value[a] <= value[b], a, b)
        span += step
    return at


def blocks(word: np.ndarray, row: np.ndarray, cfg: RepeatConfig
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, anchor hash, block hash) of every block, in order.

    Every window of a row belongs to the block of its anchor: the word
    sequence of ``anchor`` words in it with the smallest hash, the leftmost
    of equals.  A block is a run of windows with one anchor, so equal texts
    are cut at equal places whatever stands around them.
    """
    n = len(word)
    if n < cfg.window:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    gram = gram_hashes(word, cfg.anchor, 3)
    place = leftmost_minimum(mix(gram, 5), cfg.window - cfg.anchor + 1)
    inside = row[cfg.window - 1:] == row[:n - cfg.window + 1]
    start = np.flatnonzero(inside)
    place = place[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    first = start[head]
    end = start[np.append(head[1:], len(start)) - 1] + cfg.window
    return first, end, gram[place[head]], range_hashes(word, first, end)


# --- what one task can settle ------------------------------------------------

class Seen:
    """Earliest known place of sequences met in this task, bounded in size.

    A place is (doc, twin, at).  ``settle`` tells which rows have an earlier
    place that the task knows, and that place; the others have to be compared
    with other tasks.  What the bound drops is compared there as well.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.a = np.zeros(0, np.uint64)  # sorted by (a, b)
        self.b = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 3), np.int64)
        self.age = np.zeros(0, np.int64)
        self.clock = 0

    def settle(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(a), len(self.a)
        aa, bb, pp = np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.place, place])
        order = np.lexsort((pp[:, 2], pp[:, 1], pp[:, 0], bb, aa))
        sa, sb, sp = aa[order], bb[order], pp[order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        group = np.cumsum(head) - 1
        lead = np.flatnonzero(head)
        best = sp[lead][group]
        later = (sp != best).any(axis=1)
        settled, source = np.zeros(n, dtype=bool), np.zeros((n, 3), np.int64)
        mine = order >= m
        settled[order[mine] - m] = later[mine]
        source[order[mine] - m] = best[mine]
        self.clock += 1
        age = np.zeros(len(lead), np.int64)
        np.maximum.at(age, group, np.where(mine, self.clock, np.append(self.age, 0)[np.minimum(order, m)]))
        if len(lead) > self.limit:  # the longest unmet go
            keep = np.sort(np.argsort(-age, kind="stable")[:self.limit // 2])
            lead, age = lead[keep], age[keep]
        self.a, self.b, self.place, self.age = sa[lead], sb[lead], sp[lead], age
        return settled, source


def _chain(place: np.ndarray, size: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of overlapping or touching pieces of one
    document (in order) that go on in the same source at the same distance."""
    if len(place) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    go = ((place[1:, :2] == place[:-1, :2]).all(axis=1) & (source[1:, :2] == source[:-1, :2]).all(axis=1)
          & (place[1:, 2] - source[1:, 2] == place[:-1, 2] - source[:-1, 2])
          & (place[1:, 2] <= place[:-1, 2] + size[:-1]) & (place[1:, 2] > place[:-1, 2]))
    head = np.flatnonzero(np.append(True, ~go))
    last = np.append(head[1:], len(place)) - 1
    return head, place[last, 2] + size[last] - place[head, 2]


_FOUND = T.StructType([
    T.StructField("known", T.BooleanType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
    T.StructField("doc", T.LongType()), T.StructField("twin", T.IntegerType()),
    T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()),
    T.StructField("ref", T.LongType()), T.StructField("ref_at", T.IntegerType())])


def _found(a: np.ndarray, b: np.ndarray, place: np.ndarray, size: np.ndarray, seen: Seen) -> Iterator[pa.RecordBatch]:
    """Rows settled in this task, chained (``known``), and rows that are not."""
    if len(a) == 0:
        return
    settled, source = seen.settle(a, b, place)
    yes = np.flatnonzero(settled)
    head, length = _chain(place[yes], size[yes], source[yes])
    yes = yes[head]
    no = np.flatnonzero(~settled)
    row = np.concatenate([yes, no])
    known = np.arange(len(row)) < len(yes)
    spread = mix(place[row, 0].astype(np.uint64) * _STEP + place[row, 2].astype(np.uint64), 23)
    ref = np.where(known[:, None], source[row], 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(known), pa.array(np.where(known, spread, a[row]).view(np.int64)), pa.array(b[row].view(np.int64)),
         pa.array(place[row, 0]), pa.array(place[row, 1].astype(np.int32)), pa.array(place[row, 2].astype(np.int32)),
         pa.array(np.concatenate([length, size[no]]).astype(np.int32)),
         pa.array(ref[:, 0], mask=~known), pa.array(ref[:, 2].astype(np.int32), mask=~known)],
        names=_FOUND.fieldNames())


def _words_of(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, row, first word of every row and the end)."""
    data, offsets = text_buffer(part.column(column))
    starts, ends, row = words(data, offsets)
    return span_hashes(data, starts, ends), row, np.searchsorted(row, np.arange(part.num_rows + 1))


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


def _index(cfg: RepeatConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(cfg.cache)
        for batch in batches:
            for part in chunks(batch, 2):
                word, row, opens = _words_of(part, 2)
                first, end, anchor, block = blocks(word, row, cfg)
                doc, twin = _ids(part)
                owner = row[first]
                place = np.stack([doc[owner], twin[owner], first - opens[owner]], axis=1)
                yield from _found(anchor, block, place, end - first, seen)
    return run


def _anchors(cfg: RepeatConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                word, row, _ = _words_of(part, 2)
                anchor = np.unique(blocks(word, row, cfg)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[0].view(np.int64)), pa.array(anchor[1])], names=["a", "n"])
    return run


def _windows(cfg: RepeatConfig):
    """The single windows of the listed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(cfg.cache)
        for batch in batches:
            for part in chunks(batch, 2):
                word, _, opens = _words_of(part, 2)
                doc, twin = _ids(part)
                lists = part.column(3)
                per = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                at, size = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                owner = np.repeat(np.arange(part.num_rows), per)
                count = size - cfg.window + 1
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                owner, start = np.repeat(owner, count), np.repeat(at, count) + inner
                where = opens[owner] + start
                a, b = (gram_hashes(word, cfg.window, s)[where] for s in (13, 17))
                place = np.stack([doc[owner], twin[owner], start], axis=1)
                order = np.lexsort((start, owner))
                yield from _found(a[order], b[order], place[order], np.full(len(order), cfg.window), seen)
    return run


_KEPT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words outside the listed spans, joined by one space."""
    for batch in batches:
        for part in chunks(batch, 1):
            data, offsets = text_buffer(part.column(1))
            starts, ends, row = words(data, offsets)
            opens = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = part.column(2)
            edge = np.zeros(len(starts) + 1, np.int64)
            if len(lists):
                per = np.diff(lists.offsets.to_numpy())
                per = np.where(np.asarray(lists.is_valid()), per, 0)
                flat = lists.flatten()
                at, size = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                base = opens[np.repeat(np.arange(part.num_rows), per)] + at
                np.add.at(edge, base, 1)
                np.add.at(edge, base + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            stay = np.flatnonzero(~gone)
            # every kept word is followed by a space, the last one of its row is not
            width = ends[stay] - starts[stay]
            last = np.append(row[stay][1:] != row[stay][:-1], True) if len(stay) else np.zeros(0, bool)
            room = width + ~last
            new = np.concatenate([[0], np.cumsum(room)])
            out = np.full(int(new[-1]), 0x20, np.uint8)
            source = np.repeat(starts[stay], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            target = np.repeat(new[:-1], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            out[target] = data[source]
            row_end = new[np.searchsorted(row[stay], np.arange(part.num_rows + 1))]
            text = pa.LargeStringArray.from_buffers(
                part.num_rows, pa.py_buffer(row_end.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            removed = np.bincount(row[gone], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(opens)), pa.array(removed), text], names=_KEPT.fieldNames())


# --- the operator ------------------------------------------------------------

_NO_ID = (1 << 63) - 1  # a null id comes after all others


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, text, doc_id): rows with one id are told apart by their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc, F.lit(_NO_ID)).alias("doc"), F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int").alias("twin"),
                       text.alias("text"), doc.alias("doc_id"))


def _frequent_anchors(texts: DataFrame, cfg: RepeatConfig) -> list[int]:
    """Anchors that make up more than 1 / ``frequent`` of those in a sample of
    the documents: at most ``frequent`` values.  They only decide how rows are
    dealt to tasks; no result depends on them."""
    some = texts.where(F.pmod(F.xxhash64("doc", "twin"), F.lit(cfg.sample)) == 0).select("doc", "twin", "text")
    counted = some.mapInArrow(_anchors(cfg), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    hot = counted.where((F.col("n") > 8) & (F.col("n") * cfg.frequent > total.scalar()))
    return [r.a for r in hot.select("a").collect()]


def factors(spark: SparkSession, docs: DataFrame, cfg: RepeatConfig = RepeatConfig(),
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, start, length, ref_doc_id, ref_start): the parts of the
    documents that occur earlier, in words, each with its earlier place.

    The reference is the whole corpus, cut into blocks at anchors that depend
    on the words alone, so each window of ``window`` words lies in one block
    and a repeated passage is cut alike wherever it stands.  Every block is
    indexed under its anchor with its earliest place (smaller id, or same
    document and earlier start).  Documents are parsed left to right: a block
    whose whole word sequence is in the index before opens or prolongs a
    factor, as long as the earlier text goes on at the same distance.  Where
    factors begin and end the sequence of a block is not in the index as a
    whole though its anchor is; there the windows themselves are looked up.
    A window occurs earlier if and only if it lies in one of these factors.

    Most repeats are settled inside the tasks that read them, so a passage of
    all documents sends one row a task; the rest are compared where the
    anchor sends them, very frequent anchors spread by block.  Sequences are
    compared by 128 bits of hash.  Rows with equal id and text are one
    document; rows with an equal id and other texts come in the order of a
    hash of the text (``twin``); a null id comes last.  ``docs`` should be read
    from storage: a task that is run again has to see its rows in the order of
    its first run.
    """
    bounded_batches(spark)
    stash = Stash(spark, "substring-dedup")
    pieces = _factors(_texts(docs, id_col, text_col), cfg, stash).distinct()
    line = Window.partitionBy("doc", "twin", "ref", F.col("at") - F.col("ref_at")).orderBy("at", "size")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("at") > F.max(F.col("at") + F.col("size")).over(before), F.lit(True))
    runs = (pieces.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(line))
            .groupBy("doc", "twin", "ref", (F.col("at") - F.col("ref_at")).alias("shift"), "run")
            .agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end")))
    no_id = F.lit(_NO_ID)
    return runs.select(F.nullif("doc", no_id).alias("doc_id"), "twin", "start",
                       (F.col("end") - F.col("start")).alias("length"), F.nullif("ref", no_id).alias("ref_doc_id"),
                       (F.col("start") - F.col("shift")).alias("ref_start"))


def _earliest(found: DataFrame, by: list[str]) -> DataFrame:
    """Adds the rank of a place among equal sequences and the first place."""
    w = Window.partitionBy(*by).orderBy("doc", "twin", "at")
    return (found.withColumn("rank", F.rank().over(w)).withColumn("first_doc", F.first("doc").over(w))
            .withColumn("first_at", F.first("at").over(w)))


def _factor_columns() -> list[Column]:
    later = F.col("rank") > 1
    return ["doc", "twin", "at", "size", F.when(later, F.col("first_doc")).otherwise(F.col("ref")).alias("ref"),
            F.when(later, F.col("first_at")).otherwise(F.col("ref_at")).alias("ref_at")]


def _factors(texts: DataFrame, cfg: RepeatConfig, stash: Stash) -> DataFrame:
    spark = texts.sparkSession
    narrow = texts.select("doc", "twin", "text")
    hot = F.broadcast(spark.createDataFrame([(a,) for a in _frequent_anchors(texts, cfg)], "a long")
                      .withColumn("hot", F.lit(True)))
    found = narrow.mapInArrow(_index(cfg), _FOUND).join(hot, "a", "left")
    spread = F.col("hot").isNotNull()
    dealt = found.withColumn("lot", F.when(spread, F.xxhash64("a", "b")).otherwise(F.col("a"))).repartition("lot")
    lot = Window.partitionBy("lot")
    judged = _earliest(dealt, ["lot", "a", "b"]).withColumn(
        "several", spread | (F.min("b").over(lot) != F.max("b").over(lot)))
    parsed = stash.keep(
        judged.withColumn("check", ~F.col("known") & (F.col("rank") == 1))
        .where(~F.col("check") | F.col("several")).select("check", *_factor_columns()))
    asked = parsed.where("check").groupBy("doc", "twin").agg(F.collect_set(F.struct("at", "size")).alias("asked"))
    single = (narrow.join(asked, ["doc", "twin"]).select("doc", "twin", "text", "asked")
              .sortWithinPartitions("doc", "twin"))  # a task run again settles the same rows
    windows = _earliest(single.mapInArrow(_windows(cfg), _FOUND), ["a", "b"]).where("known or rank > 1")
    ends = stash.keep(windows.select(*_factor_columns()))
    return parsed.where("not check").drop("check").unionByName(ends)


def remove_repeats(spark: SparkSession, docs: DataFrame, cfg: RepeatConfig = RepeatConfig(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row: the words (runs of
    non-white characters) outside all windows of ``window`` words that occur
    earlier, joined by one space.  Windows are judged on the input.

    Null, empty and white texts have no words and become empty; texts of
    fewer words than a window stay.  The first of several occurrences stays
    whole, also within one document.  Repeated rows (equal id and text) get
    equal results.  An empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    bounded_batches(spark)
    stash = Stash(spark, "substring-dedup")
    texts = _texts(docs, id_col, text_col)
    spans = _factors(texts, cfg, stash).groupBy("doc", "twin").agg(
        F.collect_set(F.struct("at", "size")).alias("spans"))
    return (texts.join(spans, ["doc", "twin"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut, _KEPT))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query ``op13_substring_dedup``."""
    return r"""
    WITH cut AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM cut WHERE len(w) >= 20)),
    again AS (
        SELECT doc_id, i FROM windows
        QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + d AS i FROM again, (SELECT unnest(range(20)) AS d)),
    word AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM cut),
    kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n
        FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM cut LEFT JOIN kept USING (doc_id)"""
