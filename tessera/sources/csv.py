"""Strict CSV loading (S1-S8) on Spark's CSV reader.

Spark is lenient where a strict loader must not be: it renames blank and
duplicate headers, pads short rows, replaces undecodable bytes and accepts
a final unterminated quote.  The audits below make those cases errors:

* header: the first line (with ``multiline`` the first record) of every
  file, parsed with the same delimiter (S4);
* structure: rows are parsed against an all-string schema plus a
  corrupt-record column; short, long, malformed and NUL-bearing rows are
  counted by one aggregation (S5);
* encoding: raw line bytes are checked with ``is_valid_utf8`` (S6);
* types: inferred, except that date/timestamp inference is undone by
  re-reading those columns as text (S7).
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CsvFormatError, DatasetError, Ruled, TableSpec, must
from ..functions.digest import table_fingerprint
from ..functions.schema import schema_diff
from .records import csv_records, parse_records

INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
# Encoding names Spark spells differently, and the texts that
# stand for a missing value.
ENCODING_ALIASES = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-8-sig": "UTF-8", "utf8": "UTF-8",
                    "ascii": "US-ASCII", "us-ascii": "US-ASCII"}
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class CsvOptions(Ruled):
    """``max_file_size_bytes`` is an opt-in limit on the input's total size.
    ``multiline`` reads quoted fields that hold line breaks; files are still
    split between tasks (``sources/records.py``).  Quotes then belong to quoted
    fields only: one inside an unquoted field shifts the records after it."""

    error: ClassVar[type] = CsvFormatError
    encoding: str = must("utf-8-sig", "an encoding name", lambda v: type(v) is str and bool(v.strip()))
    delimiter: str = must(",", "one character other than a line end",
                          lambda v: type(v) is str and len(v) == 1 and v not in "\r\n")
    max_file_size_bytes: int | None = must(None, "None or a positive integer",
                                           lambda v: v is None or type(v) is int and v > 0)
    multiline: bool = must(False, "True or False", lambda v: type(v) is bool)

    @property
    def spark_encoding(self) -> str:
        return ENCODING_ALIASES.get(self.encoding.lower(), self.encoding)

    def reader(self, spark: SparkSession):
        """The reader that every step of a load shares: quotes inside a quoted
        field are doubled, a backslash is an ordinary character."""
        return (spark.read.option("header", True).option("sep", self.delimiter)
                .option("encoding", self.spark_encoding).option("quote", '"').option("escape", '"'))

    def rows(self, spark: SparkSession, path: str, header: list[str], schema: T.StructType, **more: str) -> DataFrame:
        """The data rows of the files in ``schema``; with ``multiline`` also
        the record itself as column ``__record``."""
        if not self.multiline:
            return self.reader(spark).schema(schema).option("enforceSchema", True).options(**more).csv(path)
        given = {"sep": self.delimiter, "quote": '"', "escape": '"', **more}
        return parse_records(csv_records(spark, path, self.spark_encoding), header, schema, given)


def total_bytes(spark: SparkSession, path: str) -> int:
    """Size of the input files from file-system metadata (no data read)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def _modified(spark: SparkSession, path: str) -> int:
    """Latest modification time of the input files (metadata only)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(hpath, True)
    latest = 0
    while files.hasNext():
        latest = max(latest, files.next().getModificationTime())
    return latest


def file_headers(spark: SparkSession, path: str, options: CsvOptions) -> DataFrame:
    """First line of every input file: ``(file_path, header_line)``.

    Only the split that starts at byte 0 of a file holds its header; within
    that split the row with the smallest monotonically increasing id is the
    first line.  One small row per file, computed on executors.
    """
    lines = spark.read.option("encoding", options.spark_encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    return (lines.filter(F.col("_start") == 0).groupBy("file_path")
            .agg(F.min_by("value", "_pos").alias("header_line")))


def read_header(spark: SparkSession, path: str, options: CsvOptions) -> list[str]:
    """Header names; blank, duplicate or NUL names, or files whose
    headers differ, are errors."""
    if options.multiline:
        headers = (csv_records(spark, path, options.spark_encoding).where("header")
                   .select(F.col("value").alias("header_line")).distinct().collect())
    else:
        headers = file_headers(spark, path, options).collect()
    if not headers:
        raise CsvFormatError("CSV file is empty.")
    distinct = {r["header_line"].lstrip("\ufeff") for r in headers}
    if len(distinct) > 1:
        raise CsvFormatError(f"Input files have {len(distinct)} different header lines.")
    line = distinct.pop()
    names = next(csv.reader(io.StringIO(line), delimiter=options.delimiter), [])
    problems = schema_diff(names).problems()
    if problems:
        raise CsvFormatError("Invalid CSV header: " + "; ".join(problems) + ".")
    return names


def structure_audit(spark: SparkSession, path: str, header: list[str], options: CsvOptions) -> DataFrame:
    """``(reason, rows, sample)`` for rows that do not match the header."""
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in header] + [T.StructField("__corrupt", T.StringType())]
    )
    rows = options.rows(spark, path, header, schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__corrupt",
                        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if options.multiline:  # a file that ends inside quotes
        odd = F.regexp_count("__record", F.lit('"')) % 2 == 1
        rows = rows.withColumn("__corrupt", F.coalesce("__corrupt", F.when(odd, F.col("__record"))))
    has_nul = F.contains("__record", F.lit("\0")) if options.multiline else F.lit(False)
    for n in header:
        has_nul = has_nul | F.coalesce(F.contains(F.col(f"`{n}`"), F.lit("\0")), F.lit(False))
    # Field count of a rejected line (only used to name the reason): delimiters
    # outside quotes, after complete quoted fields are taken out.
    bare = F.regexp_replace(F.col("__corrupt"), '"(?:[^"]|"")*+"', "")
    fields = F.size(F.split(bare, F.lit(re.escape(options.delimiter)), -1))
    bad = F.col("__corrupt").isNotNull()
    reason = (
        F.when(bad & (fields < len(header)), "too few fields")
        .when(bad & (fields > len(header)), "too many fields")
        .when(bad, "malformed row")
        .when(has_nul, "NUL character")
    )
    return (
        rows.select(reason.alias("reason"), F.coalesce(F.col("__corrupt"), F.lit("")).alias("_raw"))
        .filter(F.col("reason").isNotNull())
        .groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.min("_raw").alias("sample"))
    )


def encoding_audit(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """Files that are not valid in the declared encoding (one row per file).

    For UTF-8 the text reader keeps each line's raw bytes, so
    ``is_valid_utf8`` per line is exact.  Other encodings are decoded
    strictly: a byte the encoding does not have comes out as U+FFFD.  Files
    are split and checked in parallel like any scan.
    """
    encoding = (options or CsvOptions()).spark_encoding
    if encoding.upper() == "UTF-8":
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
        bad = ~F.is_valid_utf8(F.col("value"))
    else:
        plain = (spark.read.schema("value string").option("encoding", encoding).option("sep", "\x01")
                 .option("quote", "").csv(path))
        lines = plain.select(F.col("_metadata.file_path").alias("path"), "value")
        bad = F.contains(F.col("value"), F.lit("\ufffd"))
    return lines.filter(bad).select("path").distinct()


def _typed(spark: SparkSession, path: str, options: CsvOptions, header: list[str]) -> DataFrame:
    """Inferred types.  Missing tokens become NULL before inference, so
    they do not turn a numeric column into text; dates stay text."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in header])
    raw = options.rows(spark, path, header, text, nullValue="")
    fields = [F.col(f"`{n}`") for n in header]
    clean = raw.select(*[F.when(~F.trim(c).isin(*MISSING_TOKENS), c).alias(n) for c, n in zip(fields, header)])
    # One aggregation: the number of values of each column that each type can hold.
    fits = []
    for i, c in enumerate(fields):
        fits.append(F.count(c).alias(f"all_{i}"))
        fits.append(F.count_if(F.lower(F.trim(c)).isin("true", "false")).alias(f"boolean_{i}"))
        for kind, form in (("int", INTEGER), ("bigint", INTEGER), ("double", NUMBER)):
            fits.append(F.count_if(F.trim(c).rlike(form) & c.try_cast(kind).isNotNull()).alias(f"{kind}_{i}"))
    seen = clean.agg(*fits).first()
    out = []
    for i, (c, n) in enumerate(zip(fields, header)):
        kind = next((k for k in ("int", "bigint", "double", "boolean")
                     if seen[f"all_{i}"] and seen[f"{k}_{i}"] == seen[f"all_{i}"]), "string")
        out.append(c.cast(kind).alias(n))
    return clean.select(*out)


def load_csv(
    spark: SparkSession,
    path: str,
    *,
    target: str | None,
    key: list[str] | None = None,
    options: CsvOptions | None = None,
    strict: bool = True,
    schema: T.StructType | str | None = None,
) -> tuple[DataFrame, TableSpec]:
    """S1 (S2 with ``target=None``): audited, typed load + table spec.

    Types are inferred from the whole input by default (an extra pass, as
    the reference infers from the whole file); pass ``schema`` to skip it.
    Inference from a sample is not offered: a value outside the sample's
    type would silently become NULL.
    """
    opts = options or CsvOptions()
    before = (total_bytes(spark, path), _modified(spark, path))
    if opts.max_file_size_bytes is not None and before[0] > opts.max_file_size_bytes:
        raise CsvFormatError(f"CSV input is {before[0]} bytes; the limit is {opts.max_file_size_bytes}.")
    header = read_header(spark, path, opts)
    if strict:
        bad = encoding_audit(spark, path, opts).limit(1).collect()
        if bad:
            raise CsvFormatError(f"File {bad[0]['path']} is not valid {opts.spark_encoding}.")
        problems = structure_audit(spark, path, header, opts).collect()
        if problems:
            text = "; ".join(f"{r['reason']}: {r['rows']} rows" for r in sorted(problems, key=lambda r: r["reason"]))
            raise CsvFormatError(f"Invalid CSV rows: {text}.")
    if not opts.multiline and opts.reader(spark).csv(path).columns != header:  # S8
        raise CsvFormatError("Parsed columns do not match the validated header.")
    if schema is not None:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = opts.rows(spark, path, header, given, mode="FAILFAST", positiveInf="inf", negativeInf="-inf",
                       nanValue="NaN").select(*[F.col(f"`{f.name}`") for f in given.fields])
        if df.columns != header:
            raise CsvFormatError("The given schema does not name the header's columns.")
    else:
        df = _typed(spark, path, opts, header)
    if df.isEmpty():
        raise CsvFormatError("CSV file contains no data rows.")
    if target is not None and (not target.strip() or target not in df.columns):  # V2
        raise DatasetError(f"Target column {target!r} not found; available columns: {', '.join(df.columns)}.")
    spec = TableSpec(target=target, key=tuple(key or ()), source=path,
                     fingerprint=table_fingerprint(df), fields=tuple(df.columns), columns=tuple(df.dtypes))
    if (total_bytes(spark, path), _modified(spark, path)) != before:  # S10
        raise DatasetError(f"{path} changed while it was being loaded.")
    return df, spec


def load_feature_csv(spark: SparkSession, path: str, *, options: CsvOptions | None = None) -> DataFrame:
    """The same audited load without a target, for scoring."""
    return load_csv(spark, path, target=None, options=options)[0]


def load_table(spark: SparkSession, path: str, *, target: str | None, key: list[str]) -> tuple[DataFrame, TableSpec]:
    """Parquet through the same contract (target present, key recorded)."""
    df = spark.read.parquet(path)
    if target is not None and target not in df.columns:
        raise DatasetError(f"Target column {target!r} not found; available columns: {', '.join(df.columns)}.")
    missing = [k for k in key if k not in df.columns]
    if missing:
        raise DatasetError(f"Key columns not found: {missing}.")
    return df, TableSpec(target=target, key=tuple(key), source=path, fields=tuple(df.columns))
