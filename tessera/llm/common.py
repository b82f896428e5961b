"""Shared helpers: tables written to the shared folder, Arrow text buffers,
vectorised word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20  # text bytes handled at once inside a task


# --- shared folder -----------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It must be shared by the driver and all executors.  Only a local master
    (one process, as in tests) gets a folder of its own when it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = held.get() if held.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound the Arrow batches between Spark and the tasks' Python by bytes,
    unless the session bounds them lower: a batch of long texts then takes no
    more memory than one of short texts.  Holds for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < size <= limit:
        spark.conf.set(key, f"{limit}b")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-llm/{label}-{uuid.uuid4().hex}"


class Stash:
    """Intermediate tables written as Parquet to the shared folder.

    A written table survives the loss of any executor and cuts the lineage.
    ``keep`` writes a frame and reads it back; ``drop`` removes one that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        bounded_batches(spark)
        self.root = scratch_path(spark, label)
        self._paths: dict[int, str] = {}
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


# --- Arrow text --------------------------------------------------------------

def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with about ``limit`` text bytes
    (one row at least), so that working arrays stay small."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = WHITE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes outside ``gaps``, by
    default ``\\x20\\x09-\\x0D``."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~gaps[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a word never spans two rows
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, key: str, n: int) -> np.ndarray:
    held = _powers.get(key)
    if held is None or len(held) < n:
        size = max(n, CHUNK_BYTES + 4096)
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        held = _powers[key] = np.cumprod(full, dtype=np.uint64)
        if size > 4 * CHUNK_BYTES:  # a single huge row: don't hold its tables
            _powers.pop(key)
    return held


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser; equal input and seed give equal output everywhere."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span: a polynomial over prefix sums, mixed."""
    n = len(data)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, "p", n + 1)[:n], dtype=np.uint64, out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _power(_P_INV, "i", n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


LETTER = np.zeros(256, dtype=bool)  # ASCII letters and every byte of longer characters
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 bytes for A-Z and the Latin-1 letters (À to Þ)."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


class ScoreCache:
    """Scores of distinct tokens by hash, kept in a task's Python process.

    Its size is bounded: when it is full it keeps what it has, which the
    frequent tokens are among.  Scores are rounded to ``dtype`` whether they
    are kept or not, so a token's score never depends on the cache.
    """

    def __init__(self, width: int, limit: int = 400_000, dtype: type = np.float32) -> None:
        self.width, self.limit, self.dtype = width, limit, dtype
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, width), dtype)

    def get(self, keys: np.ndarray, score) -> np.ndarray:
        """Rows for ``keys``; ``score(index)`` gives those of unknown keys,
        named by the index of one occurrence each."""
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        out = np.zeros((len(distinct), self.width), self.dtype)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = score(first[new])
            room = new[:max(0, self.limit - len(self.keys))]
            if len(room):
                self.keys = np.concatenate([self.keys, distinct[room]])
                self.values = np.concatenate([self.values, out[room]])
                order = np.argsort(self.keys, kind="stable")
                self.keys, self.values = self.keys[order], self.values[order]
        return out[inverse.reshape(-1)]
