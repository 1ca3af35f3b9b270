"""The library's functions under SQL names of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidewater.functions import nested
from tidewater.sources import sqltext


@udtf(returnType="path string, ord int, leaf string")
class StringLeaves:
    """Strings inside a serialized or JSON value, one row each."""

    def eval(self, value: str) -> Iterator[tuple]:
        if value is not None:
            yield from nested.leaves(value)


@udtf(returnType="row_no int, `column` string, kind string, value string, `table` string")
class ParseInsert:
    """Cells of an INSERT or UPDATE; none for other statements."""

    def eval(self, sql: str) -> Iterator[tuple]:
        for c in sqltext.cells(sql) or [] if sql is not None else []:
            yield c["row_no"], c["column"], c["kind"], c["value"], c["table"]


@udtf(returnType="stmt_no int, sql string")
class SplitStatements:
    """Statements of SQL text in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, (_, _, sql) in enumerate(sqltext.split(text or "")):
            yield n, sql


def register(spark: SparkSession) -> None:
    """Add the scalar functions, which are SQL and stay in the JVM, and the table functions."""
    scalar = {
        "from_base64": ("text STRING", "BINARY", "try_to_binary(text, 'base64')"),
        "to_base64": ("value BINARY", "STRING", "regexp_replace(base64(value), '[\\r\\n]', '')"),
        "may_hold_url": ("encoded STRING", "BOOLEAN", "encoded RLIKE 'aHR0|dHA6|dHBz|dHRw'"),
    }
    for name, (args, kind, body) in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, function in (("string_leaves", StringLeaves), ("parse_insert", ParseInsert), ("split_statements", SplitStatements)):
        spark.udtf.register(name, function)
