"""Databases as sources and sinks: options of JDBC reads, and SQLite files as a Spark data source."""

from __future__ import annotations

import sqlite3
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import groupby, islice
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.functions import encode

#: Share of a time budget that one query of a source may take.
QUERY_SHARE = 0.8
ROWS = 8192


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None, driver: str | None = None, budget: float | None = None, fetch: int = 1000) -> dict[str, str]:
    """Options of ``spark.read.format('jdbc')``; a query is stopped after most of a ``budget`` of seconds."""
    found = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver, "fetchsize": str(fetch)}
    if budget is not None:
        found["queryTimeout"] = str(max(1, int(budget * QUERY_SHARE)))
    return {k: v for k, v in found.items() if v is not None}


def split_options(column: str, low: int, high: int, parts: int) -> dict[str, str]:
    """Options that cut a JDBC read into ranges of a numeric key; rows outside the bounds are read too."""
    if high < low or parts < 1:
        raise ValueError("a split needs low <= high and a part at least")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(min(parts, high - low + 1))}


def read_jdbc(spark: SparkSession, options: dict[str, str], key: str | None = None, parts: int = 1) -> DataFrame:
    """A table over JDBC, by ranges of a numeric key if one is given; filters and columns are pushed by Spark."""
    whole = spark.read.format("jdbc").options(**options)
    if key is None or parts < 2:
        return whole.load()
    bounds = spark.read.format("jdbc").options(**options | {"dbtable": f"(SELECT min({key}) AS low, max({key}) AS high FROM {options['dbtable']}) b"}).load().first()
    return whole.load() if bounds.low is None else whole.options(**split_options(key, int(bounds.low), int(bounds.high), parts)).load()


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str, write: bool = False) -> sqlite3.Connection:
    return sqlite3.connect(path, timeout=600, isolation_level=None) if write else sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=600)


def _type(declared: str) -> T.DataType:
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not d or "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


@dataclass
class Range(InputPartition):
    start: int | None
    stop: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: T.StructType) -> None:
        self.path, self.table, self.parts, self.columns = path, table, parts, schema

    def partitions(self) -> list[Range]:
        with closing(_open(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(_rowid_), max(_rowid_) FROM {_q(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Range(None, None)]
        if low is None:  # a view again, or no rows
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [("CAST({} AS TEXT)" if isinstance(f.dataType, T.StringType) else "{}").format(_q(f.name)) for f in self.columns]
        where = "" if partition.start is None else f" WHERE _rowid_ >= {partition.start} AND _rowid_ < {partition.stop}"
        schema = to_arrow_schema(self.columns)
        with closing(_open(self.path)) as con:
            found = con.execute(f"SELECT {', '.join(kinds)} FROM {_q(self.table)}{where}")
            while rows := found.fetchmany(ROWS):
                arrays = []
                for values, f in zip(zip(*rows, strict=True), schema, strict=True):
                    if pa.types.is_binary(f.type):
                        values = [str(v).encode() if v is not None and not isinstance(v, bytes) else v for v in values]
                    arrays.append(pa.array(values, f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class SqliteWriter(DataSourceWriter):
    """Tasks fill a table of their own rows; the commit moves it into the target in one transaction.

    A task that runs twice replaces what it wrote, and a job that fails leaves the target as it was.
    """

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.table, self.overwrite = path, table, overwrite
        self.names = [f.name for f in schema]
        self.stage = f"_stage_{table}"
        kind = {T.BooleanType: "INTEGER", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.BinaryType: "BLOB"}
        self.ddl = ", ".join(f"{_q(f.name)} {kind.get(type(f.dataType), 'TEXT')}" for f in schema)
        with closing(_open(path, True)) as con:
            con.execute(f"DROP TABLE IF EXISTS {_q(self.stage)}")
            con.execute(f"CREATE TABLE {_q(self.stage)} (_part INTEGER, {self.ddl})")
            con.execute(f"CREATE INDEX {_q(self.stage + '_i')} ON {_q(self.stage)} (_part)")

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        marks = ", ".join("?" * (len(self.names) + 1))

        def plain(v: object) -> object:
            return v if v is None or isinstance(v, (int, float, str, bytes)) else bytes(v) if isinstance(v, bytearray) else str(v)

        with closing(_open(self.path, True)) as con:
            con.execute("BEGIN IMMEDIATE")
            con.execute(f"DELETE FROM {_q(self.stage)} WHERE _part = ?", (part,))
            con.executemany(f"INSERT INTO {_q(self.stage)} VALUES ({marks})", ((part, *map(plain, r)) for r in iterator))
            con.execute("COMMIT")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names = ", ".join(map(_q, self.names))
        with closing(_open(self.path, True)) as con:
            con.execute("BEGIN IMMEDIATE")
            con.execute(f"CREATE TABLE IF NOT EXISTS {_q(self.table)} ({self.ddl})")
            if self.overwrite:
                con.execute(f"DELETE FROM {_q(self.table)}")
            con.execute(f"INSERT INTO {_q(self.table)} ({names}) SELECT {names} FROM {_q(self.stage)} ORDER BY _part, _rowid_")
            con.execute(f"DROP TABLE {_q(self.stage)}")
            con.execute("COMMIT")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with closing(_open(self.path, True)) as con:
            con.execute(f"DROP TABLE IF EXISTS {_q(self.stage)}")


class SqliteSource(DataSource):
    """``spark.read.format('sqlite')`` with ``path`` (of a file that all executors see), ``table`` and ``parts``.

    Tables are read by ranges of their row ids, views and others in one task. A value that the column's declared
    type does not hold stops the read; give a schema of strings to read such a table.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with closing(_open(self.options["path"])) as con:
            found = con.execute(f"SELECT name, type, pk FROM pragma_table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(n, _type(t), True, {"pk_ordinal": pk} if pk else None) for n, t, pk in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("parts", "8")), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema, overwrite)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sqlite_tables(path: str, allow: list[str] | None = None) -> list[str]:
    """Tables of a file by name, without views and the engine's own; only those allowed, if a list is given."""
    with closing(_open(path)) as con:
        names = [n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
    return [n for n in names if allow is None or n in allow]


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("parts", str(parts)).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append to a table or overwrite its rows; the table is made if there is none."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode(mode).option("path", path).option("table", table).save()


#: Templates of prepared statements that a task keeps.
TEMPLATES = 256


def write_prepared(rows: DataFrame, connect: Callable[[], Any], every: int = 1000) -> dict[str, int]:
    """Insert rows of ``sqltext.shaped`` by prepared statements, one for each table, list of columns and shape; gives rows, batches and templates made.

    ``connect`` gives a connection to SQLite, with a timeout, as that takes one writer at a time; a task commits once, at its end. Rows of a shape
    are sent together. Whole numbers are cast to NUMERIC and others to REAL, as text is bound to all. Rows without a shape are an error.
    """
    counts = {k: rows.sparkSession.sparkContext.accumulator(0) for k in ("rows", "batches", "templates")}

    def task(part: Iterator[Row]) -> None:
        con = connect()
        templates: OrderedDict[tuple, str] = OrderedDict()
        cast = {"i": "CAST(? AS NUMERIC)", "r": "CAST(? AS REAL)", "s": "?"}

        def send(key: tuple, held: list[list]) -> None:
            if key not in templates:
                table, columns, shape = key
                templates[key] = f"INSERT INTO {encode.quote(table)} ({', '.join(map(encode.quote, columns))}) VALUES ({', '.join(cast[c] for c in shape)})"
                counts["templates"].add(1)
                if len(templates) > TEMPLATES:
                    templates.popitem(last=False)
            templates.move_to_end(key)
            con.executemany(templates[key], held)
            counts["rows"].add(len(held))
            counts["batches"].add(1)

        try:
            for key, own in groupby(part, key=lambda r: (r.table, tuple(r.columns), r.shape)):
                if key[2] is None:
                    raise ValueError(f"a row of {key[0]} holds an expression")
                while some := [r.params for r in islice(own, every)]:
                    send(key, some)
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    rows.sortWithinPartitions("table", "columns", "shape").foreachPartition(task)
    return {k: c.value for k, c in counts.items()}
