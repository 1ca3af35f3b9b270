"""Scans: null-safe exclusion, keyset and offset pages, batches, catalog statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.ordered import Item, fold


def exclude(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop rows whose column equals the value; nulls stay, an unknown column is ignored."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value))) if column in df.columns else df


def after(keys: Sequence[str], values: Sequence[object]) -> Column:
    """Rows past a key in lexicographic order, as an OR of ANDs that reaches the scan as pushed filters.

    Nulls come first in an order, so after a null come the keys that are not null.
    """
    out = F.lit(False)
    same = F.lit(True)
    for k, v in zip(keys, values, strict=True):
        out = out | (same & (F.col(k).isNotNull() if v is None else F.col(k) > F.lit(v)))
        same = same & (F.col(k).isNull() if v is None else F.col(k) == F.lit(v))
    return out if values[0] is None else F.col(keys[0]).isNotNull() & (F.col(keys[0]) >= F.lit(values[0])) & out


def keyset_page(df: DataFrame, keys: Sequence[str], last: Sequence[object] | None, n: int) -> DataFrame:
    """The next ``n`` rows in key order; planned as a top-n, never a full sort."""
    return (df if last is None else df.where(after(keys, last))).orderBy(*keys).limit(n)


def offset_page(df: DataFrame, order: Sequence[str], skip: int, n: int) -> DataFrame:
    """A page by position, for tables without a key; ``order`` must be total."""
    return df.orderBy(*order).offset(skip).limit(n)


def row_batches(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Add ``batch``: runs of ``n`` rows in order within a group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n).cast("long"))


def greedy_batches(df: DataFrame, group: str, order: str, cost: str, limit: int) -> DataFrame:
    """(group, batch, n, cost): fill batches up to ``limit``, cutting before what would overflow; a large item is alone.

    The cut depends on the cut before it, so rows of a group are folded in order. A null cost is 0.
    """

    def step(a: list[int], r: Item) -> Iterator[tuple]:
        c = r[cost] or 0
        if a[1] and a[2] + c > limit:
            yield tuple(a)
            a[:] = [a[0] + 1, 0, 0]
        a[1], a[2] = a[1] + 1, a[2] + c

    rows = df.select(group, order, F.col(cost).cast("long").alias(cost))
    return fold(rows, group, [order], "batch long, n long, cost long", lambda: [0, 0, 0], step, lambda a: [tuple(a)])


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table, by name."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def columns_of(df: DataFrame) -> list[dict[str, object]]:
    """Ordinal, name, type and key position of each column (the key comes from field metadata)."""
    return [{"ordinal": i + 1, "name": f.name, "type": f.dataType.simpleString(), "key": f.metadata.get("pk_ordinal")} for i, f in enumerate(df.schema)]


def base_tables(spark: SparkSession, allow: Sequence[str] | None = None) -> list[str]:
    """Tables of the current database by name, without views; only those allowed, if a list is given."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.tableType not in ("VIEW", "TEMPORARY"))
    return [n for n in names if allow is None or n in allow]
