"""Snapshot diff, changelog merge, coalescing and deterministic dedup.

All are keyed shuffles that Spark plans as sort-merge or hash operators; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(local: DataFrame, remote: DataFrame, key: str, compare: Sequence[str], deletable: Column | None = None) -> DataFrame:
    """One row per key of either side: ``op`` (add, change, delete, same) with both sides' columns.

    ``deletable``, a condition on local columns, guards deletes: a local row outside it is kept. A null key
    equals none: such a row is a delete if local, an add if remote.
    """
    a, b = local.withColumn("_side", F.lit(True)).alias("a"), remote.withColumn("_side", F.lit(True)).alias("b")
    here, there = F.col("a._side").isNotNull(), F.col("b._side").isNotNull()
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    gone = F.lit("delete") if deletable is None else F.when(deletable, "delete").otherwise("keep")
    op = F.when(~here, "add").when(~there, gone).when(changed, "change").otherwise("same")
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(key), op.alias("op")]
    columns += [F.col(f"a.{c}").alias(f"local_{c}") for c in compare] + [F.col(f"b.{c}").alias(f"remote_{c}") for c in compare]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def merge(snapshot: DataFrame, log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """Apply an ordered log (op F upserts, D deletes; the last of a key wins) to a snapshot."""
    values = [c for c in snapshot.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(op, *values), seq).alias("u"))
    s = snapshot.alias("s")
    joined = s.join(last, key, "full_outer")
    kept = joined.where(F.col("u").isNull() | (F.col(f"u.{op}") != "D"))
    return kept.select(key, *[F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values])


def coalesce_runs(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the last row of each run of rows with one key, in the log's order (within ``order[0]`` groups)."""
    group, *rest = order
    w = Window.partitionBy(group).orderBy(*rest)
    after = F.lead(key).over(w)
    return log.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") != F.col(key))).drop("_after")


def first_by(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The first row of each key by position: a deterministic DISTINCT ON."""
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index_stats(df: DataFrame, key: str, size: str, position: str) -> DataFrame:
    """Distinct keys and the sum of their sizes; the last row of a key counts."""
    last = df.groupBy(key).agg(F.max_by(size, position).alias("size"))
    return last.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def pending(actions: DataFrame, sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of a work list and their bytes; unknown sizes count 0, repeated entries count again."""
    joined = actions.join(sizes.select(key, size), key, "left")
    return joined.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(size, F.lit(0))), F.lit(0)).alias("bytes"))
