"""Order-insensitive table and row-set digests.

A digest here is a multiset hash: every row is reduced to a text token,
each token to two 60-bit integers taken from its MD5, and the table to
``sha256("<rows>:<sum1>:<sum2>")``.  Sums are exact (DECIMAL(38,0)) and
associative, so the aggregate runs as a partial/final hash aggregation
with O(1) state: no sort, no collect, no single task holding the rows.
The same value comes out of DuckDB with ``md5``, ``'0x' || hex`` casts and
``sha256`` (see ``sql_digest``).  It detects accidental change (a row
added, dropped or altered), not adversarial collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jvm import Jvm

_WIDE = "decimal(38,0)"


def hashed_tokens(df: DataFrame, tokens: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``keep`` and, for every token, its two 60-bit integers ``<name>_1`` and
    ``<name>_2``: projected one after the other, so that a token is spelled
    and hashed once a row, however many sums read it."""
    keep = list(keep or [])
    held = df.select(*keep, *[F.md5(token).alias(name) for name, token in tokens.items()])
    return held.select(*keep, *[
        F.conv(F.substring(F.col(name), 16 * i + 1, 15), 16, 10).cast("long").alias(f"{name}_{i + 1}")
        for name in tokens for i in range(2)])


def digest_aggs(name: str) -> list[Column]:
    """Partial-aggregatable state of the digest of a hashed token: count and
    two sums.  Each is three sums of 20 bits in longs, good for 2^43 rows, put
    together as a decimal at the end."""
    def total(part: str) -> Column:
        bits = [F.sum(F.shiftright(F.col(part), 20 * i).bitwiseAND(F.lit((1 << 20) - 1))).cast(_WIDE) for i in range(3)]
        return (bits[0] + bits[1] * F.lit(1 << 20) + bits[2] * F.lit(1 << 40)).cast(_WIDE)

    return [F.count(F.lit(1)).alias("_dg_n"), total(f"{name}_1").alias("_dg_s1"), total(f"{name}_2").alias("_dg_s2")]


def digest_from_state() -> Column:
    return F.sha2(
        F.concat_ws(
            ":",
            F.col("_dg_n").cast("string"),
            F.coalesce(F.col("_dg_s1"), F.lit(0).cast(_WIDE)).cast("string"),
            F.coalesce(F.col("_dg_s2"), F.lit(0).cast(_WIDE)).cast("string"),
        ),
        256,
    )


def multiset_digest(df: DataFrame, token: Column, by: list[str] | None = None) -> DataFrame:
    """``(by..., row_count, digest)`` over the tokens of ``df``."""
    hashed = hashed_tokens(df, {"_tk": token}, by)
    grouped = hashed.groupBy(*by) if by else hashed.groupBy()
    return grouped.agg(*digest_aggs("_tk")).select(
        *(by or []),
        F.col("_dg_n").alias("row_count"),
        digest_from_state().alias("digest"),
    )


def framed(text: Column) -> Column:
    """A field of a token: its length, a colon and its text, or ``-`` for
    NULL; joined fields can be told apart whatever they hold."""
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def exact_text(d: Column) -> Column:
    """A double as a hexadecimal floating-point text, which spells every value
    exactly (both zeros alike): that of the format ``%a``, made without a format."""
    j = Jvm()
    text = j.static("java.lang.Double", "toHexString", j.object_kind("java.lang.String"), j.expression(d))
    return F.when(d == 0, "0").otherwise(j.column(
        j.static("org.apache.spark.unsafe.types.UTF8String", "fromString", j.kind("string"), text)))


def shortest_text(d: Column) -> Column:
    """A double as its shortest decimal text, which tells all values apart
    (both zeros alike) and is made faster, but differs between engines."""
    return F.when(d == 0, "0").otherwise(d.cast("string"))


def value_token(df: DataFrame, columns: list[str] | None = None, *, spell: Callable[[Column], Column] = exact_text
                ) -> Column:
    """Text token of a whole row: lossless and, as it stands, engine-independent.

    Floating values are spelled by ``spell``, exactly by default, timestamps as epoch
    microseconds, and every field is framed.
    """
    return F.concat(*[framed(text) for text in value_texts(df, columns, spell)])


def value_texts(df: DataFrame, columns: list[str] | None = None, spell: Callable[[Column], Column] = exact_text
                ) -> list[Column]:
    """The fields of a row's token before they are framed."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns or df.columns:
        dtype = fields[name]
        col = F.col(f"`{name}`")
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            text = F.when(col.isNotNull(), spell(col.cast("double")))
        elif isinstance(dtype, T.TimestampNTZType):
            # Wall-clock micros since the epoch: no session time zone involved.
            text = F.expr(
                f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)"
            ).cast("string")
        elif isinstance(dtype, T.TimestampType):
            text = F.unix_micros(col).cast("string")
        elif isinstance(dtype, T.DateType):
            text = F.datediff(col, F.lit("1970-01-01").cast("date")).cast("string")
        elif isinstance(dtype, T.BooleanType):
            text = F.when(col, "true").when(~col, "false")
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(col)
        elif isinstance(dtype, T.BinaryType):
            text = F.hex(col)
        else:
            text = col.cast("string")
        parts.append(text)
    return parts


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """64 bits of the columns' values: rows that differ in it differ, NULLs
    and both zeros compare equal; rows that share it may differ."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        col, dtype = F.col(f"`{name}`"), fields[name]
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            col = F.when(col == 0, F.lit(0).cast(dtype)).otherwise(col)
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        parts.append(col)
    return F.xxhash64(*parts)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """Fingerprint of a table's column names, types and content (one
    aggregation job)."""
    held = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    head = "".join(f"{len(part)}:{part}" for column in held.dtypes for part in column)
    # Projected one after the other, a field is spelled once, not once for its length and once for itself.
    spelled = held.select(*[text.alias(c) for text, c in zip(value_texts(held), held.columns)])
    row = multiset_digest(spelled, F.concat(*[framed(F.col(f"`{c}`")) for c in held.columns])).first()
    return hashlib.sha256(f"{head}|{row['digest']}".encode()).hexdigest()


def sql_framed(text: str) -> str:
    """DuckDB SQL of ``framed``."""
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def sql_exact_text(d: str) -> str:
    """DuckDB SQL of ``exact_text`` (for normal numbers): C writes ``p+4`` and
    leaves out an empty fraction where Java writes ``p4`` and ``.0``."""
    text = f"replace(printf('%a', {d}), 'p+', 'p')"
    return (f"CASE WHEN {d} = 0 THEN '0' WHEN contains({text}, '.') THEN {text} "
            f"ELSE replace({text}, 'p', '.0p') END")


def sql_digest(token_sql: str) -> str:
    """DuckDB/ANSI SQL expression of the digest over ``token_sql`` (aggregate)."""
    h1 = f"CAST(('0x' || substr(md5({token_sql}), 1, 15)) AS BIGINT)"
    h2 = f"CAST(('0x' || substr(md5({token_sql}), 17, 15)) AS BIGINT)"
    return (
        "sha256(CAST(count(*) AS VARCHAR) || ':' || "
        f"CAST(coalesce(sum(CAST({h1} AS HUGEINT)), 0) AS VARCHAR) || ':' || "
        f"CAST(coalesce(sum(CAST({h2} AS HUGEINT)), 0) AS VARCHAR))"
    )
