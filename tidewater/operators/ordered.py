"""Folds over the rows of a group in order, where each step needs the one before.

Rows are shuffled by group and sorted by Spark, which spills; a task then streams over them and holds one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Item = dict[str, Any]


def fold(df: DataFrame, group: str, order: Sequence[str], schema: str, start: Callable[[], Any], step: Callable[[Any, Item], Iterable[tuple]], end: Callable[[Any], Iterable[tuple]]) -> DataFrame:
    """Rows (``schema`` beside the group) that ``step`` and ``end`` give; the state is changed in place.

    ``step`` sees each row of a group in order, ``end`` the state after the last. A null group is one group.
    """
    kind = df.schema[group].dataType
    out = T.StructType([T.StructField(group, kind), *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Any = None
        now: tuple | None = None
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                if now != (r[group],):
                    if now is not None:
                        rows += [(*now, *x) for x in end(state)]
                    now, state = (r[group],), start()
                rows += [(*now, *x) for x in step(state, r)]
            yield made(rows)
        if now is not None:
            yield made([(*now, *x) for x in end(state)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, out)
