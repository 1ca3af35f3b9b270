"""Ordered folds: moving average of throughput, and additive-increase multiplicative-decrease sizes."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ordered import Item, fold


def ema(df: DataFrame, group: str, order: list[str], value: Column, alpha: float = 0.2) -> DataFrame:
    """group, n, ema: the first value seeds, then prev * (1 - alpha) + x * alpha. Null values are passed over.

    Unrolled, that is a sum of values weighted by their place from the end, which Spark combines on the map side.
    """
    rows = df.select(group, *order, value.cast("double").alias("_x")).where("_x IS NOT NULL")
    back = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(o) for o in order])) - 1)
    keep = F.lit(1 - alpha)
    n = F.count("*")
    seed = F.max_by("_x", "_k") * F.pow(keep, n)
    return back.groupBy(group).agg(n.alias("n"), (seed + F.sum(F.col("_x") * alpha * F.pow(keep, F.col("_k")))).alias("ema"))


def aimd(
    df: DataFrame, group: str, order: list[str], work: Column, elapsed: Column, failed: Column,
    start: int, low: int, high: int, increase: int, alpha: float = 0.2, drop: float = 0.9, decrease: float = 0.7, backoff: int = 3,
) -> DataFrame:
    """group, size, ema, backoff, decision after the last request of each group.

    A failure halves the size and holds it; throughput under ``drop`` of the average shrinks it,
    else it grows; no work (null counts as none) changes nothing.
    """

    def clamp(x: float) -> float:
        return max(float(low), min(float(high), x))

    def half_up(x: float) -> float:
        return float(int(x + 0.5))

    def step(a: SimpleNamespace, r: Item) -> Iterator[tuple]:
        done = r["_work"] or 0.0
        if r["_failed"]:
            a.size, a.hold, a.decision = clamp(half_up(a.size * 0.5)), max(a.hold, backoff), "backoff"
        elif done <= 0:
            a.decision = "no_work"
        else:
            speed = done / max(1e-4, r["_elapsed"] or 0.0)
            if a.hold > 0:
                a.decision = "error_backoff"
            elif a.ema is None:
                a.decision = "warmup"
            elif a.ema and speed / a.ema < drop:
                a.size, a.decision = clamp(half_up(a.size * decrease)), "decrease"
            else:
                a.size, a.decision = clamp(a.size + increase), "increase"
            a.ema = speed if a.ema is None else a.ema * (1 - alpha) + speed * alpha
            a.hold = max(a.hold - 1, 0)
        return iter(())

    rows = df.select(group, *order, work.cast("double").alias("_work"), elapsed.cast("double").alias("_elapsed"), F.coalesce(failed, F.lit(False)).alias("_failed"))
    return fold(
        rows, group, order, "size long, ema double, backoff long, decision string",
        lambda: SimpleNamespace(size=float(start), ema=None, hold=0, decision="none"), step, lambda a: [(int(a.size), a.ema, a.hold, a.decision)],
    )


def pause(elapsed: Column, done: Column, duty: float = 0.5, low: float = 0.2, high: float = 10.0) -> Column:
    """Seconds to rest after a request so that work takes ``duty`` of the time; none after the last."""
    return F.when(done, 0.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), elapsed * (1 / duty - 1))))
