"""Spelling variants: a bit-sliced position index over the vocabulary, whose
zero-error and one-error sets are tracked for many words at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, Stash, chunks, text_buffer


@dataclass(frozen=True)
class SpellingConfig:
    """``shortest``: code points of a word at least, 3 or more.  ``least``:
    occurrences at least.  ``times``: how often a form occurs for each
    occurrence of its variant.  ``drop``: one in so many (document, run) pairs loses a
    letter by its hash, 0 for none.  ``page``: words of one index.  ``block``:
    queries of one block that a task answers."""

    shortest: int = 6
    least: int = 5
    times: int = 5
    drop: int = 199
    page: int = 1024
    block: int = 50_000


# --- words of the texts (inside tasks) -----------------------------------------

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of A-Z, a-z and the characters
    U+00C0 to U+00FF, which are the UTF-8 pairs that begin with 0xC3."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = data == 0xC3
    solid = _ASCII[data] | lead
    solid[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of every byte range, going on from the checksum ``seeds``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    out = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    first, size = starts[order], size[order]
    wide = int(np.searchsorted(-size, -64, "left"))  # these few go one by one
    left = len(order)
    for j in range(int(size[wide]) if wide < left else 0):
        left = wide + int(np.searchsorted(-size[wide:], -j, "left"))
        state = out[wide:left]
        out[wide:left] = _CRC[(state ^ data[first[wide:left] + j]) & 255] ^ (state >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(wide):
        out[i] = zlib.crc32(data[first[i]:first[i] + size[i]].tobytes(), int(seeds[order[i]]))
    back = np.empty(len(order), np.uint32)
    back[order] = out
    return back


_COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def _count_words(cfg: SpellingConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                raw, offsets = text_buffer(part.column(1))
                data = LOWER[raw]
                starts, ends, row = letter_runs(data, offsets)
                begins = (data & 0xC0) != 0x80  # bytes that open a code point
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum(begins, out=points[1:])
                length = points[ends] - points[starts]
                room = np.flatnonzero(length >= cfg.shortest)
                starts, ends, row, length = starts[room], ends[room], row[room], length[room]
                lost = np.zeros(len(starts), dtype=bool)
                gone = np.zeros(len(data) + 1, np.int64)  # bytes taken out
                if cfg.drop and len(starts):
                    ids = part.column(0).to_pylist()
                    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                    h = run_checksums(data, starts, ends, seeds[row])
                    lost = h % np.uint32(cfg.drop) == 0
                    which = points[starts[lost]] + h[lost].astype(np.int64) % length[lost]
                    byte = np.flatnonzero(begins)[which]
                    gone[byte] = 1
                    gone[byte[data[byte] == 0xC3] + 1] = 1
                stay = length - lost >= cfg.shortest
                starts, ends = starts[stay], ends[stay]
                edge = np.zeros(len(data) + 1, np.int64)
                edge[starts] += 1
                np.add.at(edge, ends, -1)
                keep = (np.cumsum(edge)[:-1] > 0) & (gone[:-1] == 0)
                less = np.concatenate([[0], np.cumsum(gone)])
                size = (ends - starts) - (less[ends] - less[starts])
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(data[keep]))
                counted = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays(
                    [counted.field("values"), counted.field("counts")], names=_COUNTS.fieldNames())
    return run


# --- the index (inside tasks) ------------------------------------------------

def position_sets(codes: np.ndarray, length: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For every position and letter the set of words that have it there, as
    bits in 64-bit lanes: positions x (letters + 1) x lanes.  ``codes`` holds
    letter numbers, words x positions; the last set of a position is empty."""
    n, width = codes.shape
    lanes = -(-n // 64)
    one = np.zeros((width + 1, len(letters) + 1, lanes * 64), dtype=bool)
    word, at = np.nonzero(np.arange(width) < length[:, None])
    one[at, codes[word, at], word] = True
    return np.packbits(one, axis=-1, bitorder="little").view(np.uint64)


def _bits(mask: np.ndarray) -> np.ndarray:
    lanes = -(-len(mask) // 64)
    return np.packbits(np.pad(mask, (0, lanes * 64 - len(mask))), bitorder="little").view(np.uint64)


def near_sets(query: np.ndarray, m: int, sets: np.ndarray, fits: dict[int, np.ndarray], low: int, high: int
              ) -> np.ndarray:
    """Queries x lanes: the indexed words one edit away from every query of
    ``m`` letters whose common beginning with it has ``low`` to ``high`` - 1
    letters.  ``fits`` has the sets of words by length; lengths it lacks are
    not looked for.

    After i letters of a query, ``zero`` holds the words that begin with them,
    ``swapped`` those with one other letter among them, ``longer`` those with
    one letter more (read one position ahead) and ``shorter`` those with one
    letter less (read one position behind).
    """
    lanes = sets.shape[-1]
    zero = np.full((len(query), lanes), ~np.uint64(0))
    swapped, longer, shorter = (np.zeros_like(zero) for _ in range(3))
    bounds = zero.copy()
    for i in range(m):
        if i == low:
            bounds &= zero
        if i == high:
            bounds &= ~zero
        letter = query[:, i]
        same = sets[i, letter]
        if m in fits:
            swapped = (swapped & same) | (zero & ~same)
        if m + 1 in fits:
            longer = (longer | zero) & sets[i + 1, letter]
        if m - 1 in fits:
            shorter = (shorter & sets[i - 1, letter] if i else shorter) | zero
        zero = zero & same
    near = np.zeros_like(zero)
    for size, found in ((m, swapped), (m + 1, longer | zero), (m - 1, shorter)):
        if size in fits:
            near |= found & fits[size]
    return near & bounds


_NEAR = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
    T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def _answer(words: list[bytes], n: np.ndarray, asks: np.ndarray, shorter: int, low: int, high: int, page: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, near words, best near word) by position, for the words with
    ``asks``.  Pairs of ``shorter`` letters, and of these with one more."""
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))  # the best near word has the lowest bit
    length = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    letters, number = np.unique(flat, return_inverse=True)
    codes = np.full((len(words), shorter + 1), len(letters))
    codes[np.arange(shorter + 1) < length[:, None]] = number
    total, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for a in range(0, len(words), page):
        mine = order[a:a + page]
        sets = position_sets(codes[mine], length[mine], letters)
        fits = {k: _bits(length[mine] == k) for k in (shorter, shorter + 1)}
        for m, wanted in ((shorter, fits), (shorter + 1, {shorter: fits[shorter]})):
            queries = np.flatnonzero(asks & (length == m))
            for b in range(0, len(queries), page):
                q = queries[b:b + page]
                near = near_sets(codes[q], m, sets, wanted, low, high)
                total[q] += np.bitwise_count(near).sum(axis=1, dtype=np.int64)
                lane = (near != 0).argmax(axis=1)
                bits = near[np.arange(len(q)), lane]
                hit = (bits != 0) & (best[q] < 0)
                lowest = np.bitwise_count((bits & -bits) - np.uint64(1)).astype(np.int64)
                best[q[hit]] = mine[(lane * 64 + lowest)[hit]]
    query = np.flatnonzero(total > 0)
    return query, total[query], best[query]


def _look_up(cfg: SpellingConfig):
    """Gathers whole blocks of one kind into pages and answers their queries.
    A block whose queries are dealt to several tasks is a page of its own."""
    def close(rows: dict) -> Iterator[pa.RecordBatch]:
        words = rows["word"]
        shorter, low, high = rows["kind"][:3]
        query, total, best = _answer([w.encode("latin-1") for w in words], np.array(rows["n"], np.int64),
                                     np.array(rows["asks"], bool), shorter, low, high, cfg.page)
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in query]), pa.array(total), pa.array([rows["n"][i] for i in best]),
                 pa.array([words[i] for i in best])], names=_NEAR.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"kind": None, "word": [], "n": [], "asks": []}
        block = None
        for batch in batches:
            col = batch.to_pydict()
            for kind, key, word, n, asks in zip(
                    zip(col["shorter"], col["low"], col["high"], col["tile"], col["tiles"]), col["piece"],
                    col["word"], col["n"], col["asks"]):
                alone = kind[4] > 1 and (kind, key) != block
                if kind != held["kind"] or alone or (len(held["word"]) >= cfg.page and (kind, key) != block):
                    if held["word"]:
                        yield from close(held)
                    held = {"kind": kind, "word": [], "n": [], "asks": []}
                block = (kind, key)
                held["word"].append(word)
                held["n"].append(n)
                held["asks"].append(asks)
        if held["word"]:
            yield from close(held)
    return run


# --- the operator ------------------------------------------------------------

def vocabulary(docs: DataFrame, cfg: SpellingConfig = SpellingConfig(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (texts.mapInArrow(_count_words(cfg), _COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= cfg.least))


def _pieces(cfg: SpellingConfig) -> Column:
    """The blocks of a word: for each length that the shorter word of a pair
    may have, cut in three pieces, the word without one of its pieces.

    One edit leaves two of three pieces as they are.  The common beginning of
    a pair says which: it ends in the third piece (first two equal), in the
    second or in the first, and the pair counts in that block alone.
    """
    m = F.length("word")

    def of(shorter: Column) -> Column:
        a = F.floor(shorter / 3).cast("int")
        b = shorter - 2 * a
        word = F.col("word")
        parts = [(a + b, shorter + 2, F.substring(word, F.lit(1), a + b)),
                 (F.lit(0), a, F.right(word, a + b)),
                 (a, a + b, F.concat(F.left(word, a), F.right(word, a)))]
        return F.array(*[F.struct(shorter.alias("shorter"), low.alias("low"), high.alias("high"),
                                  piece.alias("piece")) for low, high, piece in parts])

    return F.flatten(F.transform(F.filter(F.array(m, m - 1), lambda k: k >= cfg.shortest), of))


def near_words(words: DataFrame, stash: Stash, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``words`` (word, n) with
    a word at one edit: their number and the most frequent of them, of equals
    the smallest in code-point order."""
    block = ["shorter", "low", "high", "piece"]
    spread = words.select("word", "n", F.explode(_pieces(cfg)).alias("k")).select("word", "n", "k.*")
    large = stash.keep(spread.groupBy(*block).agg(F.count("*").alias("members"))
                       .where(F.col("members") > cfg.block))
    tiles = F.coalesce(F.ceil(F.col("members") / cfg.block), F.lit(1)).cast("int")
    dealt = (spread.join(large, block, "left").withColumn("tiles", tiles)
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("asks", F.pmod(F.xxhash64("word"), F.col("tiles")) == F.col("tile"))
             .repartition(*block, "tile").sortWithinPartitions("shorter", "low", "high", "tiles", "piece", "tile", "word")
             .select("shorter", "low", "high", "tile", "tiles", "piece", "word", "n", "asks"))
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return (dealt.mapInArrow(_look_up(cfg), _NEAR).groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), best.alias("top"))
            .select("word", "n_near", (-F.col("top.least")).alias("best_n"), F.col("top.best").alias("best")))


def _roots(forms: DataFrame, stash: Stash) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by doubling.
    A form occurs several times as often as its variant, so chains are short."""
    cur = stash.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not cur.where("moved").isEmpty():
        up = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        cur = stash.keep(cur.join(up, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return cur.select("word", "root")


def spelling_variants(spark: SparkSession, docs: DataFrame, cfg: SpellingConfig = SpellingConfig(),
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    Words are the runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of whole
    texts, A-Z in lower case, at least ``shortest`` code points long after the
    hashed loss of a letter and found ``least`` times.  Two are near if one
    inserted, deleted or replaced code point makes them equal.  The form of a
    word is its most frequent near word (of equals the smallest) if that is
    ``times`` as frequent, its root the last of its chain of forms, or itself.

    Words meet in blocks that share two of three pieces, indexed in pages of
    bit sets by position and letter.  The queries of a block of more than
    ``block`` words are dealt to several tasks, which all index the block.
    Null and empty texts have no words; a null id hashes as an empty string;
    repeated rows count each.  An empty table gives an empty result; other columns
    of ``docs`` are not read.
    """
    if cfg.shortest < 3:
        raise ValueError("words are cut in three pieces and need three letters at least")
    if cfg.times < 2:
        raise ValueError("a form must be more frequent than its variant, or chains would not end")
    stash = Stash(spark, "spelling")
    words = stash.keep(vocabulary(docs, cfg, id_col, text_col))
    near = stash.keep(words.join(near_words(words, stash, cfg), "word").withColumn(
        "form", F.when(F.col("best_n") >= cfg.times * F.col("n"), F.col("best"))).drop("n"))
    roots = _roots(near.where("form is not null"), stash)
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query ``op12_spelling``.  CRC-32 goes
    byte by byte; near words share a text with one letter left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE crc(i, v) AS (
        SELECT i, list_reduce([i] || range(8), lambda s, k:
            CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)
        FROM (SELECT unnest(range(256)) AS i)),
    run AS (
        SELECT doc_id, translate(r, '{upper}', '{upper.lower()}') AS r, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents)
        GROUP BY ALL HAVING length(r) >= 6),
    step(doc_id, r, n, x, pos, s) AS (
        SELECT doc_id, r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), 0, 4294967295 FROM run
        UNION ALL
        SELECT doc_id, r, n, x, pos + 2, xor(s >> 8, v)
        FROM step JOIN crc ON i = xor(s, ('0x' || x[pos + 1:pos + 2])::BIGINT) & 255
        WHERE pos < length(x)),
    hashed AS (SELECT r, n, xor(s, 4294967295) AS h FROM step WHERE pos = length(x)),
    vocab AS (
        SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word,
               sum(n)::BIGINT AS n
        FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
    less AS (
        SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS v
        FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM vocab)),
    pair AS (
        SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM vocab a JOIN less b ON a.word = b.v
        UNION SELECT b.word, a.word, a.n FROM vocab a JOIN less b ON a.word = b.v),
    best AS (
        SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS top, max(n) AS top_n
        FROM pair GROUP BY word),
    formed AS (
        SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * v.n THEN top END AS form,
               CASE WHEN top_n >= 5 * v.n THEN top_n END AS form_n
        FROM vocab v LEFT JOIN best USING (word)),
    climb(word, root) AS (
        SELECT word, word FROM formed
        UNION ALL SELECT c.word, f.form FROM climb c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
    FROM formed f JOIN climb c ON c.word = f.word JOIN formed r ON c.root = r.word WHERE r.form IS NULL"""
