"""CSV records whose quoted fields hold line breaks, read in parallel.

A line begins a record if the file holds an even number of quote characters
before it.  That needs no sequential read:

1. every file block (what one task reads of a file) counts its quotes;
2. a prefix sum over the blocks of a file tells which begin inside quotes;
3. every task then knows where records begin in its block and puts their
   lines together; what a block lacks at its end stands at the beginning of
   the following ones, and these few pieces are joined by their file and block.

A block without a single record start (it lies inside one long field) is such
a piece as a whole.  Lines end in ``\\n`` or ``\\r\\n``; line breaks inside
quotes are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE, _HEAD, _TAIL = 0, 1, 2  # a record; the end of one; the beginning of one
_PIECES = "file bigint, block bigint, kind int, first boolean, value string"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return (spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), "value"))


class _Assembler:
    """Puts together the records of one block, batch by batch."""

    def __init__(self, file: int, block: int, inside: bool) -> None:
        self.file, self.block = file, block
        self.odd = inside          # quotes before the next line, modulo 2
        self.held: list[pa.Array] = []  # lines since the last record start
        self.begun = not inside    # whether these lines begin with a start
        self.starts = 0            # records given out

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        after = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + self.odd) % 2
        start = np.flatnonzero(np.concatenate([[self.odd], after[:-1]]) == 0)
        self.odd = int(after[-1])
        if len(start) == 0:
            self.held.append(lines)
            return
        if self.held or start[0] > 0:  # what was open ends before the first start
            yield from self._close(lines[:start[0]], _WHOLE if self.begun else _HEAD)
        last = start[-1]
        self.held, self.begun = [lines[last:]], True
        if len(start) > 1:
            yield self._rows(_joined(lines[:last], start[:-1]), _WHOLE)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            kind = _HEAD if not self.begun else _TAIL if self.odd else _WHOLE
            yield from self._close(None, kind)

    def _close(self, more: pa.Array | None, kind: int) -> Iterator[pa.RecordBatch]:
        parts = self.held + ([more] if more is not None and len(more) else [])
        self.held = []
        if parts:
            lines = pa.concat_arrays(parts)
            yield self._rows(_joined(lines, np.zeros(1, np.int64)), kind)

    def _rows(self, values: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(values)
        if kind != _TAIL:  # a tail's last line break is inside quotes
            values = pc.replace_substring_regex(values, pattern="\r$", replacement="")
        first = np.zeros(n, dtype=bool)
        if kind != _HEAD:
            first[0] = self.starts == 0
            self.starts += n
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.file)), pa.array(np.full(n, self.block)),
             pa.array(np.full(n, kind), pa.int32()), pa.array(first), values],
            names=["file", "block", "kind", "first", "value"])


def _joined(lines: pa.Array, start: np.ndarray) -> pa.Array:
    """The lines from every start to the next, joined by line breaks."""
    if len(start) == len(lines):
        return lines
    off = pa.array(np.append(start, len(lines)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(off, lines), "\n")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Assembler | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(file)]):
            if now is None or (now.file, now.block) != (file[a], block[a]):
                if now is not None:
                    yield from now.end()
                now = _Assembler(file[a], block[a], batch.column(2)[int(a)].as_py())
            yield from now.add(batch.column(3).slice(a, b - a))
    if now is not None:
        yield from now.end()


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(value, header)``: every record of the files, without its last line
    break, and whether it is the first of its file.  Empty lines between
    records are left out."""
    lines = _lines(spark, path, encoding)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = (parity.withColumn("before", F.sum("quotes").over(earlier)).where("before % 2 = 1")
              .select("file", "block", F.lit(True).alias("inside")))
    # At most one row for each block of input, so a millionth of its size;
    # a broadcast join also keeps the lines in their order.
    pieces = (lines.join(F.broadcast(inside), ["file", "block"], "left")
              .select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
              .mapInArrow(_assemble, _PIECES))
    whole = pieces.where(F.col("kind") == _WHOLE)
    upto = Window.partitionBy("file").orderBy("block", "kind")
    opened = F.last(F.when(F.col("kind") == _TAIL, F.col("block")), ignorenulls=True).over(upto)
    stitched = (pieces.where(F.col("kind") != _WHOLE).withColumn("opened", opened).groupBy("file", "opened")
                .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"),
                     F.bool_or("first").alias("first"))
                .select(F.col("opened").alias("block"), "first",
                        F.regexp_replace(F.array_join("parts.value", "\n"), "\r$", "").alias("value")))
    every = whole.select("block", "first", "value").unionByName(stitched)
    return every.where("value <> ''").select(
        "value", (F.col("first") & (F.col("block") == 0)).alias("header"))


def parse_records(records: DataFrame, header: list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The records as rows of ``schema``, whose columns beyond the header's
    are those that ``options`` name (the corrupt record), and ``__record``."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields[:len(header)])]
                         + schema.fields[len(header):])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.fields)
    row = records.where(~F.col("header")).select("value", F.from_csv("value", ddl, options).alias("r"))
    return row.select(F.col("value").alias("__record"), *[F.col(f"r.`{p.name}`").alias(f.name) for p, f in zip(plain.fields, schema.fields)])
