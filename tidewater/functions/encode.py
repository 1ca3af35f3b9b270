"""Typed literals, base64 and sizes, all as built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What encoded text of a value with ``http`` in it must contain, at the three byte alignments.
URL_MARKS = "aHR0|dHA6|dHBz|dHRw"


def to_base64(value: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Bytes; null where the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def from_base64_lenient(text: Column) -> Column:
    """Bytes of what is base64 in the text: other characters are passed over, and so is padding, or the lack of it."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9+/]", "")
    # One character over is no byte.
    plain = F.when(F.length(plain) % 4 == 1, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def may_hold_url(encoded: Column) -> Column:
    return F.rlike(encoded, F.lit(URL_MARKS))


def literal(value: Column, kind: T.DataType, json: bool = False) -> Column:
    """SQL literal: NULL, a bare number, '', or FROM_BASE64('...'); JSON text is converted to utf8mb4.

    Booleans are 1 and 0; a number that has no literal (NaN, infinity) is NULL; dates and times go as their text.
    """
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.cast("int").cast("string"), F.lit("NULL"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(value.isNull() | odd, "NULL").otherwise(value.cast("string"))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.cast("string"), F.lit("NULL"))
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        value = value.cast("string")
    raw = F.concat(F.lit("FROM_BASE64('"), to_base64(value), F.lit("')"))
    body = F.concat(F.lit("CONVERT("), raw, F.lit(" USING utf8mb4)")) if json else raw
    return F.when(value.isNull(), "NULL").when(F.octet_length(value) == 0, "''").otherwise(body)


def encoded_size(value: Column, kind: T.DataType) -> Column:
    """Bytes that the literal takes."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.length(value.cast("string")), F.lit(4)).cast("long")
    n = F.octet_length(value if isinstance(kind, (T.StringType, T.BinaryType)) else value.cast("string"))
    return F.when(value.isNull(), 4).when(n == 0, 2).otherwise(F.lit(15) + 4 * F.floor((n + 2) / 3)).cast("long")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def equals(key: str, kind: T.DataType) -> Column:
    """A condition on a key as SQL text; null is IS NULL."""
    name = F.lit(quote(key))
    return F.when(F.col(quote(key)).isNull(), F.concat(name, F.lit(" IS NULL"))).otherwise(F.concat(name, F.lit(" = "), literal(F.col(quote(key)), kind)))


def insert_statements(df: DataFrame, table: str, order: list[str], batch: int = 250, parts: int | None = None, json: Sequence[str] = ()) -> DataFrame:
    """part, stmt_no, sql: INSERTs of at most ``batch`` rows in key order.

    Rows are range-partitioned by key and numbered within their part, so no task sees all rows; the
    statements of a part end with a short one. ``parts``: as many as Spark shuffles into, if not given.
    """
    row = F.concat(F.lit("("), F.concat_ws(",", *[literal(F.col(quote(f.name)), f.dataType, f.name in json) for f in df.schema]), F.lit(")"))
    keyed = df.select(F.struct(*[F.col(quote(o)).alias(f"k{i}") for i, o in enumerate(order)]).alias("k"), row.alias("row")).repartitionByRange(*([parts] if parts else []), "k").withColumn("part", F.spark_partition_id())
    numbered = keyed.withColumn("stmt_no", F.floor((F.row_number().over(Window.partitionBy("part").orderBy("k")) - 1) / batch))
    head = f"INSERT INTO {quote(table)} ({', '.join(map(quote, df.columns))}) VALUES\n"
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"])
    return numbered.groupBy("part", "stmt_no").agg(F.concat(F.lit(head), F.array_join(rows, ",\n"), F.lit(";")).alias("sql"))


def quoted(name: Column) -> Column:
    """An identifier between backticks."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def is_text(value: Column) -> Column:
    """Whether the first 64 bytes, one at least, are UTF-8 without control bytes other than tab, line and form feed, and carriage return."""
    head = F.substring(value.cast("binary"), 1, 64).cast("string")
    return (F.octet_length(value) > 0) & F.is_valid_utf8(head) & ~F.rlike(head, F.lit("[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]"))


def with_placeholders(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows with '' for each cell of more than ``limit`` bytes: what their INSERT holds before the UPDATEs fill it."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(F.octet_length(F.col(column).cast("binary")) > limit, F.lit("").cast(kind)).otherwise(F.col(column)))


def oversized_updates(df: DataFrame, table: str, key: str | list[str], column: str, limit: int) -> DataFrame:
    """key columns, chunk, n_bytes, sql: a cell of more than ``limit`` bytes as UPDATEs that append its pieces in order."""
    if not key:
        raise ValueError("an oversized row needs a primary key")
    keys = [key] if isinstance(key, str) else key
    where = F.concat_ws(" AND ", *[equals(k, df.schema[k].dataType) for k in keys])
    data = F.col(column).cast("binary")
    rows = df.where(F.octet_length(data) > limit).select(*keys, data.alias("d"))
    pieces = rows.select(*keys, "d", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("d") - 1) / limit).cast("int"))).alias("chunk"))
    piece = F.substring("d", F.col("chunk") * limit + 1, F.lit(limit))
    name = quote(column)
    sql = F.concat(F.lit(f"UPDATE {quote(table)} SET {name} = CONCAT({name}, FROM_BASE64('"), to_base64(piece), F.lit("')) WHERE "), where, F.lit(";"))
    return pieces.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.octet_length(piece).cast("long").alias("n_bytes"), sql.alias("sql"))


def bytes_of(text: Column) -> Column:
    """Bytes of sizes such as 16M, 2g or 512; null for other text."""
    t = F.trim(text)
    n = F.try_to_number(F.nullif(F.regexp_extract(t, "^([0-9]{1,12})[KkMmGg]?$", 1), F.lit("")), F.lit("999999999999")).cast("long")
    unit = F.lower(F.right(t, F.lit(1)))
    return n * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("long")


def size_text(n: Column) -> Column:
    """A count of bytes for people: 512 B, 1.5 KB, 2.0 MB, 3.0 GB."""
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", n / F.lit(float(unit))), F.lit(" " + name))
    return F.when(n >= 1 << 30, scaled(1 << 30, "GB")).when(n >= 1 << 20, scaled(1 << 20, "MB")).when(n >= 1 << 10, scaled(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex; the key is the driver's and goes into the plan only as its two padded forms."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)
