"""Toxicity: support vector machine on a gap-weighted subsequence string
kernel with Nyström landmarks, trained on labelled sentences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import (LETTER, ScoreCache, Stash, chunks, fold_case, mix, span_hashes, text_buffer, words)
from tessera.llm.near_dedup import bucket_leaders


@dataclass(frozen=True)
class ToxicConfig:
    """``sample_docs``: labelled documents a class that are learned from, picked
    by a hash of their id.  ``decay``: weight of each position a subsequence
    of ``order`` letters spans; ``power``: exponent of the normalised kernel.
    At least ``telling``, and ``common``, landmarks are drawn from the sample,
    two telling ones at most ``alike``; every unit that leans to the toxic
    class by a likelihood ratio root of ``sure`` has a landmark that much like
    it, however many that takes.  ``window``: a longer unit is read in
    half-overlapping windows of so many letters.
    ``penalty``: weight of the squared norm against the hinge loss.
    ``rounds`` of choosing the toxic documents' sentences to learn from;
    ``fit_parts``: partitions of the bounded sample while it is fitted."""

    sample_docs: int = 1000
    telling: int = 24
    common: int = 8
    alike: float = 0.6
    sure: float = 3.5
    order: int = 3
    decay: float = 0.7
    power: int = 2
    window: int = 12
    penalty: float = 3e-4
    rounds: int = 3
    fit_parts: int = 4
    threshold: float = 0.7


# --- units and sentences (inside tasks) -------------------------------------------
#
# A unit is a white-space-delimited word from its first to its last letter;
# three or more single letters in a row form one unit.  A sentence ends after
# a word that ends in . ! or ?, or at a line break.

_END = np.zeros(256, dtype=bool)
_END[[33, 46, 63]] = True
_NOT_LETTER = bytes(i for i in range(256) if not LETTER[i])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, sentence, row of every sentence): each unit's span, its
    sentence's number, and the rows the sentences belong to."""
    starts, ends, rows = words(data, offsets)
    if len(starts) == 0:
        return starts, ends, starts, starts
    line = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data == 10) | (data == 13), out=line[1:])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = ((rows[1:] != rows[:-1]) | (line[starts[1:]] != line[ends[:-1]])
                 | (_END[data[ends[:-1] - 1]] & (ends[:-1] - starts[:-1] > 1)))
    sentence = np.cumsum(opens) - 1
    sentence_row = rows[opens]
    letters = np.flatnonzero(LETTER[data])
    first = np.searchsorted(letters, starts)
    last = np.searchsorted(letters, ends) - 1
    has = last >= first
    starts, ends = letters[first[has]], letters[last[has]] + 1
    sentence = sentence[has]
    single = ends - starts == 1
    head = np.ones(len(starts), dtype=bool)  # first unit of a run of single letters, or any other
    head[1:] = ~(single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
    run = np.flatnonzero(head)
    size = np.diff(np.append(run, len(starts)))
    joined = size >= 3
    tail = run + size - 1
    keep = np.repeat(~joined, size)  # units outside joined runs stay as they are
    s = np.concatenate([starts[keep], starts[run[joined]]])
    e = np.concatenate([ends[keep], ends[tail[joined]]])
    k = np.concatenate([sentence[keep], sentence[run[joined]]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order], k[order], sentence_row


def spell(data: np.ndarray, start: int, end: int) -> bytes:
    """The unit's letters behind a mark for its beginning."""
    return b"\x01" + data[start:end].tobytes().translate(None, _NOT_LETTER)


# --- the kernel -------------------------------------------------------------------

def _matrix(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((len(strings), max(map(len, strings), default=1) or 1), dtype=np.uint8)
    for i, s in enumerate(strings):
        out[i, :len(s)] = np.frombuffer(s, dtype=np.uint8)
    return out


def _common(a: np.ndarray, target: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernel of every column of ``a`` (letters x strings, 0 after the end)
    with the same column of ``target`` (or its only column)."""
    m, n = len(target), a.shape[1]
    step, square = np.float32(decay), np.float32(decay * decay)
    prime = [np.zeros((m, n), np.float32) for _ in range(order)]  # K'_l up to each target letter
    prime[0][:] = 1
    total = np.zeros(n, np.float32)
    run = np.empty(n, np.float32)
    for x in a:
        match = ((x == target) & (x != 0)) * square
        total += (match * prime[order - 1]).sum(axis=0)
        for level in range(order - 1, 0, -1):
            gained = match[:-1] * prime[level - 1][:-1]
            prime[level] *= step
            run[:] = 0
            for j in range(1, m):
                run *= step
                run += gained[j - 1]
                prime[level][j] += run
    return total


def subsequence_kernel(a: np.ndarray, t: bytes, order: int, decay: float) -> np.ndarray:
    """Sum over common subsequences of exactly ``order`` letters of
    decay^(span in a + span in t), for every zero-padded row of ``a``."""
    return _common(np.ascontiguousarray(a.T), np.frombuffer(t, dtype=np.uint8)[:, None], order, decay)


class Subsequences:
    """The kernel with many strings at once: every subsequence of ``order``
    letters that occurs in one of ``landmarks`` has a row of its weights in
    all of them, so a string's kernel values are the weighted sum of the rows
    of its own subsequences.  The rows are found through a table over the
    letters of the landmarks; ``fits`` is False where that grows too large."""

    def __init__(self, landmarks: list[bytes], order: int, decay: float) -> None:
        letters = np.unique(np.frombuffer(b"".join(landmarks), dtype=np.uint8))
        self.order, self.decay, self.base = order, decay, len(letters) + 1
        self.fits = self.base ** order <= 1 << 24 and max(map(len, landmarks), default=0) <= MOST_LETTERS
        if not self.fits:
            return
        self.index = np.zeros(256, dtype=np.int32)  # 0: in no landmark
        self.index[letters] = np.arange(1, self.base)
        held: dict[int, np.ndarray] = {}
        for j, t in enumerate(landmarks):
            digits = self.index[np.frombuffer(t, dtype=np.uint8)].tolist()
            for at in combinations(range(len(t)), order):
                code = 0
                for i in at:
                    code = code * self.base + digits[i]
                row = held.setdefault(code, np.zeros(len(landmarks), np.float32))
                row[j] += decay ** (at[-1] - at[0] + 1)
        self.row = np.zeros(self.base ** order, dtype=np.int32)
        self.row[list(held)] = np.arange(1, len(held) + 1)
        self.weights = np.stack([np.zeros(len(landmarks), np.float32), *held.values()])

    def kernel(self, block: np.ndarray) -> np.ndarray:
        """Kernel of every zero-padded row of ``block`` with every landmark."""
        digits = np.ascontiguousarray(self.index[block].T)
        out = np.zeros((block.shape[0], self.weights.shape[1]), np.float32)

        def extend(code: np.ndarray, who: np.ndarray, first: int, last: int, size: int) -> None:
            for i in range(last + 1, len(digits) - (self.order - size)):
                digit = digits[i][who]
                alive = np.flatnonzero(digit)
                longer = code[alive] * self.base + digit[alive]
                begin = i if size == 1 else first
                if size < self.order:
                    extend(longer, who[alive], begin, i, size + 1)
                    continue
                row = self.row[longer]
                hit = np.flatnonzero(row)
                out[who[alive[hit]]] += self.weights[row[hit]] * np.float32(self.decay ** (i - begin + 1))

        extend(np.zeros(len(block), dtype=np.int64), np.arange(len(block)), 0, -1, 1)
        return out


MOST_LETTERS = 16  # of a string whose subsequences are enumerated


def normalised_kernel(strings: list[bytes], landmarks: list[bytes], cfg: ToxicConfig,
                      table: Subsequences | None = None) -> np.ndarray:
    """Kernel of every string with every landmark over their own kernels'
    geometric mean, to the given power; strings of fewer than ``order``
    letters have 0.  ``table``, where given and large enough, is that of the
    landmarks; otherwise the kernel's recurrence runs for one after another."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    own = np.zeros(len(strings))
    lengths = np.array([len(s) for s in strings])
    order = np.argsort(lengths, kind="stable")
    for lo in range(0, len(order), 8192):
        rows = order[lo:lo + 8192]
        block = _matrix([strings[i] for i in rows])
        if table is not None and table.fits and block.shape[1] <= MOST_LETTERS:
            out[rows] = table.kernel(block)
        else:
            for j, t in enumerate(landmarks):
                out[rows, j] = subsequence_kernel(block, t, cfg.order, cfg.decay)
        letters = np.ascontiguousarray(block.T)
        own[rows] = _common(letters, letters, cfg.order, cfg.decay)
    theirs = np.array([float(subsequence_kernel(_matrix([t]), t, cfg.order, cfg.decay)[0]) for t in landmarks])
    scale = np.sqrt(np.maximum(own[:, None] * theirs[None, :], 1e-12))
    return np.where(own[:, None] > 0, out / scale, 0) ** cfg.power


def windowed(strings: list[bytes], width: int) -> tuple[list[bytes], np.ndarray]:
    """Strings longer than ``width`` as half-overlapping windows; (windows,
    index of the string each belongs to)."""
    parts, owner = [], []
    for i, s in enumerate(strings):
        stops = range(0, max(len(s) - width // 2, 1), width // 2) if len(s) > width else (0,)
        for at in stops:
            parts.append(s[at:at + width])
            owner.append(i)
    return parts, np.array(owner, dtype=np.int64)


@dataclass
class KernelMap:
    """Nyström map: kernel values with the landmarks times the inverse square
    root of the landmarks' own kernel matrix.  A sentence's kernel value with
    a landmark is the largest of its units', so neither its length nor a
    repeated unit adds up."""

    landmarks: list[bytes]
    cfg: ToxicConfig
    root: np.ndarray = field(init=False)
    table: Subsequences | None = field(init=False, default=None)  # made in the task, not sent to it

    def __post_init__(self) -> None:
        gram = normalised_kernel(self.landmarks, self.landmarks, self.cfg).astype(float)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    def units(self, strings: list[bytes]) -> np.ndarray:
        """Kernel values of every unit; of a long one, the largest of its windows'."""
        if self.table is None:
            self.table = Subsequences(self.landmarks, self.cfg.order, self.cfg.decay)
        parts, owner = windowed(strings, self.cfg.window)
        raw = normalised_kernel(parts, self.landmarks, self.cfg, self.table)
        first = np.searchsorted(owner, np.arange(len(strings)))
        out = raw[first]
        more = np.flatnonzero(np.diff(np.append(first, len(parts))) > 1)
        for i in more:
            out[i] = raw[first[i]:first[i + 1] if i + 1 < len(first) else len(parts)].max(axis=0)
        return out

    def sentences(self, values: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Features of ``n`` sentences from their units' kernel values, given
        in order of ``sentence``."""
        out = np.zeros((n, len(self.landmarks)), np.float32)
        half = values.dtype == np.float16
        if half:
            values = values.view(np.uint16)  # none is below 0, so the bits have the values' order
        while len(sentence):  # neighbours of a sentence in pairs, until one row is left of each
            lead = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
            size = np.diff(np.append(lead, len(sentence)))
            if size.max() == 1:
                out[sentence] = values.view(np.float16) if half else values
                break
            place = np.arange(len(sentence)) - np.repeat(lead, size)
            even = np.flatnonzero(place % 2 == 0)
            paired = np.flatnonzero(place[even] + 1 < np.repeat(size, size)[even])
            merged = values[even]
            merged[paired] = np.maximum(merged[paired], values[even[paired] + 1])
            values, sentence = merged, sentence[even]
        return out @ self.root


@dataclass
class ToxicModel:
    """Weights of a sentence's features, and the calibration of their margin."""

    kernel: KernelMap
    weights: np.ndarray
    intercept: float
    levels: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0]))
    shares: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """The share of toxic documents at this margin (isotonic, interpolated);
        a hundredth of the score keeps equal shares in order of margin."""
        order = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        return 0.99 * np.interp(margin, self.levels, self.shares) + 0.01 * order


_caches: dict[str, ScoreCache] = {}


def sentence_keys(hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """A hash of every sentence's units."""
    key = np.zeros(n, dtype=np.uint64)
    np.add.at(key, sentence, mix(hashes, 71))
    return key.view(np.int64)


def sentence_features(data: np.ndarray, offsets: np.ndarray, kernel: KernelMap, name: str
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, key) of every sentence."""
    folded = fold_case(data)
    starts, ends, sentence, rows = units(folded, offsets)
    if name not in _caches:
        _caches.clear()
        _caches[name] = ScoreCache(len(kernel.landmarks), dtype=np.float16)
    values = np.zeros((0, len(kernel.landmarks)))
    hashes = span_hashes(folded, starts, ends)
    if len(starts):
        values = _caches[name].get(
            hashes, lambda new: kernel.units([spell(folded, starts[i], ends[i]) for i in new]))
    return kernel.sentences(values, sentence, len(rows)), rows, sentence_keys(hashes, sentence, len(rows))


def text_margins(data: np.ndarray, offsets: np.ndarray, model: ToxicModel) -> np.ndarray:
    """The largest margin of each text's sentences; without any, the intercept."""
    features, rows, _ = sentence_features(data, offsets, model.kernel, model.name)
    out = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(out, rows, features @ model.weights + model.intercept)
    return np.where(np.isfinite(out), out, model.intercept)


# --- training ----------------------------------------------------------------------

_UNIT = T.StructType([T.StructField("unit", T.BinaryType()), T.StructField("sentence", T.LongType()),
                      T.StructField("toxic", T.IntegerType())])
_SENTENCE = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("sentence", T.LongType()),
    T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))])
_KEY = T.StructType(_SENTENCE.fields[:3])


def train_model(spark: SparkSession, labelled: DataFrame, cfg: ToxicConfig = ToxicConfig(),
                labels: DataFrame | None = None) -> ToxicModel | None:
    """A model from ``labelled`` (doc_id, text, toxic 0/1); null ids, texts
    and labels teach nothing; None where a class is missing.  The labels may
    stand in a table of their own, ``labels`` (doc_id, toxic): it meets the
    ids and digests of the texts, and no text but the sample's is shuffled.

    Labels mark documents, sentences are learned from: of a toxic document
    those that the model of the round before finds toxic, the most toxic one
    in any case (at first the one most like the telling landmarks); of other
    documents all, as clean.
    Copies and near copies of a text, and copies of a sentence, teach once; a
    sentence that clean documents have too is clean.
    """
    stash = Stash(spark, "toxic")
    texts = (labelled.where("text is not null and doc_id is not null")
             .withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", F.unhex(F.md5("text"))))
    known = texts.drop("text")
    if labels is not None:
        known = texts.select("doc_id", "key").join(
            labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "doc_id")
    firsts = stash.keep(known.where("toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
                        .groupBy("key").agg(F.min(F.struct("doc_id", "toxic")).alias("one")).select("key", "one.*"))
    totals = {r["toxic"]: r["n"] for r in firsts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    pick = lambda y: firsts.where(F.col("toxic") == y).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(cfg.sample_docs)
    picked = pick(0).unionByName(pick(1)).groupBy("doc_id").agg(F.min(F.struct("key", "toxic")).alias("one"))
    sample = stash.keep(texts.select("doc_id", "text", "key")
                        .join(F.broadcast(picked.select("doc_id", "one.*")), ["doc_id", "key"])  # 2 * sample_docs rows
                        .dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"))
    single = bucket_leaders(sample)
    sample = stash.keep(sample.join(single, "doc_id", "left_semi").select("doc_id", "text", "toxic"))
    # Which sentences teach is settled on their keys; features are made once
    # for these, and never shuffled.
    keys = stash.keep(sample.select("doc_id", "text", "toxic").mapInArrow(_keys, _KEY).distinct())
    landmarks, telling = _landmarks(sample, cfg, stash)
    kernel = KernelMap(landmarks, cfg)
    once = keys.where("toxic = 0").groupBy("sentence").agg(F.min("doc").alias("doc"))
    mine = keys.where("toxic = 1").join(once.select("sentence"), "sentence", "left_anti")
    wanted = once.select("doc", "sentence").unionByName(mine.select("doc", "sentence")).groupBy("doc").agg(
        F.collect_list("sentence").alias("wanted"))
    rows = stash.keep(sample.join(wanted, sample["doc_id"] == wanted["doc"]).select("doc_id", "text", "toxic", "wanted")
                      .mapInArrow(_featurise(kernel, uuid.uuid4().hex), _SENTENCE))
    clean, bags = rows.where("toxic = 0"), rows.where("toxic = 1")
    weights, intercept = np.linalg.solve(kernel.root, telling), -np.inf
    for _ in range(cfg.rounds):
        scored = bags.withColumn("m", _margin(weights, 0.0))
        best = scored.groupBy("doc").agg(F.max(F.struct("m", "sentence")).alias("top"))
        witness = (scored.join(F.broadcast(best), "doc")  # at most sample_docs rows
                   .where((F.col("m") + intercept > 0) | (F.col("sentence") == F.col("top.sentence")))
                   .dropDuplicates(["sentence"]).select("doc", "sentence", "toxic", "features"))
        train = clean.unionByName(witness).withColumn("x", array_to_vector("features")).coalesce(cfg.fit_parts).cache()
        counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            train.unpersist()
            return None
        train = train.withColumn("weight", F.when(F.col("toxic") == 1, counts[0] / counts[1]).otherwise(1.0))
        svm = LinearSVC(featuresCol="x", labelCol="toxic", weightCol="weight", regParam=cfg.penalty,
                        standardization=False, maxIter=50).fit(train)
        train.unpersist()
        weights, intercept = svm.coefficients.toArray(), float(svm.intercept)
    judged = rows.select("sentence", _margin(weights, intercept).alias("margin")).groupBy("sentence").agg(
        F.max("margin").alias("margin"))
    docs = keys.join(judged, "sentence").groupBy("doc", "toxic").agg(F.max("margin").alias("margin"))
    held = [min(totals[y], cfg.sample_docs) for y in (0, 1)]
    share = F.when(F.col("toxic") == 1, totals[1] / held[1]).otherwise(totals[0] / held[0])
    iso = IsotonicRegression(featuresCol="margin", labelCol="toxic", weightCol="weight").fit(
        docs.select("margin", F.col("toxic").cast("double").alias("toxic"), share.alias("weight")))
    return ToxicModel(kernel, weights, intercept, iso.boundaries.toArray(), iso.predictions.toArray())


def _margin(weights: np.ndarray, intercept: float) -> F.Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with("features", w, lambda x, y: x * y), F.lit(float(intercept)),
                       lambda total, v: total + v)


def _landmarks(sample: DataFrame, cfg: ToxicConfig, stash: Stash) -> tuple[list[bytes], np.ndarray]:
    """Landmarks and each one's weight in the first choice of sentences: first
    the beginnings of units (of more letters than ``order``, up to the whole
    unit) whose sentences lean most to the toxic class, the longer of equals
    first, leaving out those too much alike, until all that surely lean have a
    like one; then the most common units."""
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                data, offsets = text_buffer(part.column(1))
                folded = fold_case(data)
                starts, ends, sentence, rows = units(folded, offsets)
                keys = sentence_keys(span_hashes(folded, starts, ends), sentence, len(rows))
                label = np.array(part.column(2).to_pylist(), dtype=np.int32)
                seen = set()
                for s, e, k in zip(starts, ends, sentence):
                    unit = spell(folded, s, e)[:cfg.window]
                    seen.update((unit[:n], k) for n in range(cfg.order + 2, len(unit) + 1))
                at = np.array([k for _, k in seen], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in seen], pa.binary()), pa.array(keys[at]), pa.array(label[rows[at]])],
                    names=_UNIT.fieldNames())
    parts = sample.select("doc_id", "text", "toxic").mapInArrow(spelled, _UNIT)
    once = parts.groupBy("unit", "sentence").agg(F.min("toxic").alias("toxic"))
    held = stash.keep(once.groupBy("unit").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")))
    total = parts.groupBy("sentence").agg(F.min("toxic").alias("toxic")).agg(
        F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    n1, n0 = max(total["a"] or 0, 1), max((total["n"] or 0) - (total["a"] or 0), 1)
    share = F.col("n") / (n1 + n0)
    z = ((F.col("a") / n1 - (F.col("n") - F.col("a")) / n0)
         / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12))
    b, p = F.col("n") - F.col("a"), n1 / (n1 + n0)
    ratio = (F.col("a") * F.log(F.col("a") / (F.col("n") * p))  # Dunning's: holds for rare units too
             + F.when(b > 0, b * F.log(b / (F.col("n") * (1 - p)))).otherwise(0.0))
    sure = F.coalesce((F.col("a") > 0) & (z > 0) & (F.sqrt(2 * ratio) >= cfg.sure), F.lit(False))
    ranked = held.select("unit", z.alias("z"), sure.alias("sure"))
    first = [F.desc("z"), F.desc(F.length("unit")), "unit"]
    leaning = ranked.where("sure").orderBy(*first).collect()
    leaning += ranked.where("not sure").orderBy(*first).limit(40 * cfg.telling).collect()
    telling: list[bytes] = []
    weights: list[float] = []
    plain = replace(cfg, power=1)
    strings = [bytes(r["unit"]) for r in leaning]
    nearest = np.zeros(len(leaning))
    for i, r in enumerate(leaning):
        if nearest[i] >= cfg.alike or not (r["sure"] or len(telling) < cfg.telling):
            continue
        telling.append(strings[i])
        weights.append(max(r["z"], 0.0))
        nearest = np.maximum(nearest, normalised_kernel(strings, strings[i:i + 1], plain)[:, 0])
    common = [bytes(r["unit"]) for r in held.orderBy(F.desc("n"), "unit").limit(cfg.common + len(telling)).collect()]
    landmarks = telling + [u for u in common if u not in telling][:cfg.common]
    return landmarks, np.array(weights + [0.0] * (len(landmarks) - len(telling)))


def _labels(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(document, label) of the rows."""
    return (np.array(part.column(0).to_pylist(), dtype=np.int64), np.array(part.column(2).to_pylist(), dtype=np.int32))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of all sentences."""
    for batch in batches:
        for part in chunks(batch, 1):
            data, offsets = text_buffer(part.column(1))
            folded = fold_case(data)
            starts, ends, sentence, rows = units(folded, offsets)
            keys = sentence_keys(span_hashes(folded, starts, ends), sentence, len(rows))
            doc, label = _labels(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[rows]), pa.array(keys), pa.array(label[rows])], names=_KEY.fieldNames())


def _featurise(kernel: KernelMap, name: str):
    """Features of the wanted sentences of every document, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                features, rows, keys = sentence_features(*text_buffer(part.column(1)), kernel, name)
                doc, label = _labels(part)
                lists = part.column(3)
                asked = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                want = set(zip(asked.tolist(), lists.flatten().to_pylist()))
                _, first = np.unique(np.stack([rows, keys], axis=1), axis=0, return_index=True)
                take = np.array([i for i in np.sort(first) if (int(rows[i]), int(keys[i])) in want], dtype=np.int64)
                width = features.shape[1]
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(take) + 1) * width, pa.int32()),
                    pa.array(features[take].ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[rows[take]]), pa.array(keys[take]), pa.array(label[rows[take]]), values],
                    names=_SENTENCE.fieldNames())
    return run


# --- the operator --------------------------------------------------------------------

_SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_toxicity(docs: DataFrame, model: ToxicModel | None, cfg: ToxicConfig = ToxicConfig(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row: the calibrated probability of
    its most toxic sentence; predicted is 1 from ``cfg.threshold`` on.

    Null and empty texts, and texts without letters, have the score of a
    sentence without units; without a model every score is 0.  Repeated rows
    get equal scores; null ids stay null; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        out = texts.select("doc_id", F.lit(0.0).alias("score"))
    else:
        out = texts.mapInArrow(_score(model), _SCORE)
    return out.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def _score(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                margins = text_margins(*text_buffer(part.column(1)), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.probability(margins))], names=_SCORE.fieldNames())
    return run


def clean_documents(spark: SparkSession, docs: DataFrame, model: ToxicModel | None,
                    cfg: ToxicConfig = ToxicConfig()) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``cfg.threshold``; each
    row is judged by its own text, so repeated or null ids do not matter."""
    if model is None:
        return docs
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                score = model.probability(text_margins(*text_buffer(part.column(at)), model))
                yield part.filter(pa.array(score < cfg.threshold))
    return docs.select(*names).mapInArrow(keep, docs.schema)
