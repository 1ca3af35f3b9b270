"""Streams with state of their own: statements of dumps that come in chunks, and keys that keep failing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.sources.dumpfile import Splitter

STATEMENTS = "dump string, stmt_no long, byte_start long, byte_end long, status string, sql string"
#: What is kept of a dump between batches: the next chunk, the lexer's state, bytes held and half a mark, places, and chunks that came too early.
_LEXER = "seq long, state int, held binary, half binary, stmt_no long, byte_start long, stalled boolean, later_seq array<long>, later_data array<binary>, later_last array<boolean>"


def statements(chunks: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Statements of a stream of chunks (dump, seq, data, last), each dump's in the order of ``seq`` from 0, whatever the order in which they come.

    A chunk that comes again is passed over. The lexer's state is kept between batches, so a restarted query goes on at its place.
    ``status`` is ``ok``; ``unended`` for a text that ends inside quotes or a comment; and ``stalled`` for the pieces of a statement
    that grows beyond ``limit`` bytes: they are given as they come, so the state stays bounded, and the scan goes on behind it.
    """

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, lexer, number, start, stalled = 0, Splitter(), 0, 0, False
        later: dict[int, tuple[bytes, bool]] = {}
        if state.exists:
            seq, lexer.state, held, lexer.half, number, start, stalled, *early = state.get
            lexer.parts, lexer.half = [bytes(held)] if held else [], bytes(lexer.half)
            later = {int(n): (bytes(d), bool(e)) for n, d, e in zip(*early)}
        for x in parts:
            for n, data, last in zip(x.seq, x.data, x["last"]):
                if n >= seq:
                    later.setdefault(int(n), (bytes(data or b""), bool(last)))
        rows: list[tuple] = []

        def add(text: bytes, status: str, ended: bool = True) -> None:
            nonlocal number, start
            rows.append((key[0], number, start, start + len(text), status, text.decode("utf-8", "replace")))
            start += len(text)
            number += ended

        while seq in later:
            data, last = later.pop(seq)
            seq += 1
            for keep, text in lexer.cut(data, last):
                if not keep and not stalled:
                    start += len(text)
                    continue
                status = "stalled" if stalled else "unended" if last and not text.rstrip().endswith(b";") and lexer.open_at_end else "ok"
                add(text, status)
                stalled = False
            size = sum(map(len, lexer.parts))
            if size > limit:
                add(b"".join(lexer.parts), "stalled", ended=False)
                lexer.parts, stalled = [], True
        state.update((seq, lexer.state, b"".join(lexer.parts), lexer.half, number, start, stalled, list(later), [d for d, _ in later.values()], [e for _, e in later.values()]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATEMENTS.split(", ")])

    grouped = chunks.select("dump", "seq", "data", "last").groupBy("dump")
    return grouped.applyInPandasWithState(run, STATEMENTS, _LEXER, "append", GroupStateTimeout.NoTimeout)


FAILING = "key string, at timestamp, failures int, status string"


def failing(events: DataFrame, tries: int = 3, late: str = "10 minutes", forget_ms: int = 3_600_000) -> DataFrame:
    """Failures in a row of each key of a stream of events (key, at, ok), as they change: ``failing``, ``quarantined`` from ``tries`` on, ``cleared`` by a success.

    Events count in the order of their time within a batch; those later than the watermark are dropped. A key that is failing, and of which nothing is
    heard for ``forget_ms`` of event time, is ``forgotten``.
    """

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FAILING.split(", ")]
        count = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), count, "forgotten")], columns=columns)
            return
        rows: list[tuple[Any, ...]] = []
        seen = pd.concat(list(parts)).sort_values(["at", "ok"], kind="stable")
        for at, ok in zip(seen["at"], seen["ok"]):
            if not ok:
                count += 1
                rows.append((key[0], at, count, "quarantined" if count >= tries else "failing"))
            elif count:
                count = 0
                rows.append((key[0], at, 0, "cleared"))
        if count:
            state.update((count,))
            latest = max(int(seen["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(latest + forget_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=columns)

    grouped = events.select("key", "at", "ok").withWatermark("at", late).groupBy("key")
    return grouped.applyInPandasWithState(run, FAILING, "failures int", "append", GroupStateTimeout.EventTimeTimeout)


def failing_batch(events: DataFrame, tries: int = 3) -> DataFrame:
    """key, failures, status of keys with failures since their last success, over a whole table."""
    ends = events.groupBy("key").agg(F.max(F.when(F.col("ok"), F.struct("at", "ok"))).alias("_end"))
    after = events.join(ends, "key").where(~F.col("ok") & (F.col("_end").isNull() | (F.struct("at", "ok") > F.col("_end"))))
    counted = after.groupBy("key").agg(F.count("*").cast("int").alias("failures"))
    return counted.withColumn("status", F.when(F.col("failures") >= tries, "quarantined").otherwise("failing"))
