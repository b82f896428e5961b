"""Language identification by prediction by partial matching: byte context
trees of every language with escape probabilities give exact code lengths
under frozen statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import (LETTER, ScoreCache, bounded_batches, chunks, fold_case, span_hashes, text_buffer, words)


@dataclass(frozen=True)
class LangConfig:
    """``order``: longest context in bytes.  ``sample_bytes``: about so many
    bytes of text a language are counted; documents are picked by a hash of
    their id, whole."""

    order: int = 4
    sample_bytes: int = 1_500_000
    unknown: str = "und"


# --- counting and coding (inside tasks) ----------------------------------------
#
# A text is coded word by word: a word is a run of letters, lower-cased,
# coded byte by byte and ended by a space; contexts reach back to the space
# before the word, not beyond, so the code length of a text is the sum over
# its words.

def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each between two spaces, and each word's offset."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths + 2, out=offsets[1:])
    out = np.full(offsets[-1], 32, dtype=np.uint8)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(offsets[:-1] + 1, lengths) + place] = data[np.repeat(starts, lengths) + place]
    return out, offsets


def _contexts(spelled: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all coded bytes and how many bytes of context each has."""
    position = np.ones(len(spelled), dtype=bool)
    position[offsets[:-1]] = False
    at = np.flatnonzero(position)
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - 1)
    return at, np.minimum(at - offsets[word], order)


def _key(spelled: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes before each position ``ends``, with their number."""
    key = np.full(len(ends), length + 1, dtype=np.uint64)
    for j in range(length, 0, -1):
        key = key << np.uint64(8) | spelled[ends - j].astype(np.uint64)
    return key


def count_contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row -> (keys, counts) of context + byte strings up to ``order`` + 1 bytes."""
    folded = fold_case(data)
    starts, ends, rows = words(folded, offsets, ~LETTER)
    out = {}
    for row in np.unique(rows):
        mine = rows == row
        spelled, at_word = _spelled(folded, starts[mine], ends[mine])
        at, depth = _contexts(spelled, at_word, order)
        keys = np.concatenate([_key(spelled, at[depth >= k] + 1, k + 1) for k in range(order + 1)])
        out[int(row)] = np.unique(keys, return_counts=True)
    return out


class ContextModel:
    """Frozen code lengths of all languages (escape method C).

    In a context seen n times with q different bytes, a byte seen c times
    costs -log2(c / (n + q)), an escape to the next shorter context
    -log2(q / (n + q)); a context never seen is left for free; below the
    empty context a byte costs 8 bits.
    """

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.name = uuid.uuid4().hex
        self.languages, self.order = languages, order
        self.keys = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.zeros(0, np.uint64)
        self.bits = np.full((len(self.keys), len(languages)), np.inf, dtype=np.float32)
        contexts = []
        for keys, counts in tables:
            context = self._context(keys)
            own, group = np.unique(context, return_inverse=True)
            n = np.bincount(group, weights=counts, minlength=len(own))
            q = np.bincount(group, minlength=len(own))
            contexts.append((own, -np.log2(q / (n + q)), group, n + q))
        self.context_keys = np.unique(np.concatenate([c[0] for c in contexts])) if tables else np.zeros(0, np.uint64)
        self.escape = np.zeros((len(self.context_keys), len(languages)), dtype=np.float32)
        for i, ((keys, counts), (own, escape, group, total)) in enumerate(zip(tables, contexts)):
            self.bits[np.searchsorted(self.keys, keys), i] = -np.log2(counts / total[group])
            self.escape[np.searchsorted(self.context_keys, own), i] = escape

    @staticmethod
    def _context(keys: np.ndarray) -> np.ndarray:
        """The key of the string without its last byte."""
        out = np.zeros_like(keys)
        for length in range(1, 8):
            mine = (keys >> np.uint64(8 * length)) == np.uint64(length + 1)
            out[mine] = (keys[mine] >> np.uint64(8)) - (np.uint64(1) << np.uint64(8 * (length - 1)))
        return out

    def cost(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length in bits of every word in every language."""
        spelled, offsets = _spelled(data, starts, ends)
        at, depth = _contexts(spelled, offsets, self.order)
        total = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        open_ = np.ones(total.shape, dtype=bool)
        for k in range(self.order, -1, -1):
            here = np.flatnonzero((depth >= k) & open_.any(axis=1))
            if len(here) == 0:
                continue
            bits = self._rows(self.keys, self.bits, _key(spelled, at[here] + 1, k + 1), np.inf)
            escape = self._rows(self.context_keys, self.escape, _key(spelled, at[here], k), 0)
            seen = np.isfinite(bits)
            total[here] += np.where(open_[here], np.where(seen, bits, escape), 0)
            open_[here] &= ~seen
        total[open_] += 8
        return np.add.reduceat(total, offsets[:-1] - np.arange(len(offsets) - 1), axis=0)

    @staticmethod
    def _rows(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((len(wanted), table.shape[1]), missing, dtype=np.float32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[hit] = table[at[hit]]
        return out


_caches: dict[str, ScoreCache] = {}


def code_lengths(data: np.ndarray, offsets: np.ndarray, model: ContextModel) -> np.ndarray:
    """Bits of every text in every language."""
    folded = fold_case(data)
    starts, ends, rows = words(folded, offsets, ~LETTER)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if len(starts) == 0:
        return out
    if model.name not in _caches:
        _caches.clear()
        _caches[model.name] = ScoreCache(len(model.languages))
    bits = _caches[model.name].get(span_hashes(folded, starts, ends),
                                   lambda new: model.cost(folded, starts[new], ends[new]))
    for i in range(out.shape[1]):
        out[:, i] = np.bincount(rows, weights=bits[:, i], minlength=len(out))
    return out


# --- the operator ---------------------------------------------------------------

_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("key", T.LongType()),
                        T.StructField("n", T.LongType())])
_GUESS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
                       T.StructField("score", T.DoubleType())])


def train_model(labelled: DataFrame, cfg: LangConfig = LangConfig()) -> ContextModel:
    """Context statistics of every language in ``labelled`` (doc_id, text,
    lang); null texts and languages teach nothing.  Counting runs in Spark;
    one total and one bound a language and the summed counts of the bounded sample come to
    the driver."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    # the first documents of each language in hash order, until the byte bound is
    # reached; sought among those below four times its share, and the very first
    spot = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))) / F.lit(2.0 ** 64) + 0.5
    sized = known.select("lang", spot.alias("spot"), F.octet_length("text").alias("bytes"))
    volume = sized.groupBy("lang").agg(F.sum("bytes").alias("bytes"), F.min("spot").alias("first")).collect()
    bounds = [x for r in volume for x in (F.lit(r["lang"]), F.lit(max(
        float(r["first"]), 4 * cfg.sample_bytes / max(r["bytes"], 1))))]
    if bounds:
        upto = Window.partitionBy("lang").orderBy("spot").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        near = sized.where(F.col("spot") <= F.create_map(*bounds)[F.col("lang")]).groupBy("lang", "spot").agg(
            F.sum("bytes").alias("bytes")).withColumn("before", F.sum("bytes").over(upto) - F.col("bytes"))
        ends = near.where((F.col("before") < cfg.sample_bytes)).groupBy("lang").agg(F.max("spot").alias("end")).collect()
        last = F.create_map(*[x for r in ends for x in (F.lit(r["lang"]), F.lit(r["end"]))])[F.col("lang")]
    picked = known.where(spot <= last if bounds else F.lit(False)).select("lang", "text")
    order = cfg.order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                langs = part.column(0).to_pylist()
                held: dict[str, list[np.ndarray]] = {}
                for row, (keys, n) in count_contexts(*text_buffer(part.column(1)), order).items():
                    held.setdefault(langs[row], []).append(np.stack([keys.view(np.int64), n]))
                for lang, pieces in held.items():
                    both = np.concatenate(pieces, axis=1)
                    keys, group = np.unique(both[0], return_inverse=True)
                    n = np.bincount(group, weights=both[1]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=_COUNTS.fieldNames())

    counts = picked.mapInArrow(count, _COUNTS).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pandas().sort_values(["lang", "key"])
    languages, tables = [], []
    for lang, part in table.groupby("lang", sort=True):
        languages.append(lang)
        tables.append((part["key"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.float64)))
    return ContextModel(languages, tables, order)


def predict_language(spark: SparkSession, docs: DataFrame, model: ContextModel,
                     cfg: LangConfig = LangConfig(), id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language with the
    shortest code (ties: the first in order) and its posterior under equal
    priors, 2^-bits over the sum of all languages' 2^-bits.

    A null text, a text without a letter, or a model without languages gives
    ``cfg.unknown`` and score 0.  Repeated rows get equal results; null ids
    stay null.
    """
    bounded_batches(spark)
    unknown = cfg.unknown

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                data, offsets = text_buffer(part.column(1))
                n = part.num_rows
                ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
                has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(map(str.isalpha, part.column(1)[int(i)].as_py()))
                if not model.languages:
                    has[:] = False
                names, score = np.full(n, unknown, dtype=object), np.zeros(n)
                if has.any():
                    bits = code_lengths(data, offsets, model)
                    best = bits.argmin(axis=1)
                    rest = np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                    names[has] = np.array(model.languages, dtype=object)[best[has]]
                    score[has] = 1 / rest[has]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score)], names=_GUESS.fieldNames())

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(guess, _GUESS)
