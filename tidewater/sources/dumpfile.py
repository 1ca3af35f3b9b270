"""Dump files as statements, one file read by many tasks.

Spark's text reader cuts a file at every ';' and reads it by splits. Whether a ';' ends a statement depends
on all before it, so each split first gives a map from the state it may begin in (plain, three quotes, two comments) to the
state it ends in; composed in the order of the file, the maps tell every split its true state, its place and
its first statement's number. A second scan then gives the statements. One that goes over the border of splits comes in
pieces, two for each border at most, which alone are shuffled.

The composition runs on the driver over one row a split, which is what a scan's own plan holds there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States: between tokens with only comments and space so far, or with more; in quotes; in comments, of a statement blank so far or not.
PLAIN, SOME, SINGLE, DOUBLE, NAME, LINE, LINE_SOME, BLOCK, BLOCK_SOME = STATES = range(9)
_AFTER = {SINGLE: SOME, DOUBLE: SOME, NAME: SOME, LINE: PLAIN, LINE_SOME: SOME, BLOCK: PLAIN, BLOCK_SOME: SOME}
_CLOSE = {
    SINGLE: re.compile(rb"[^'\\]*+(?:\\.[^'\\]*+)*+'", re.S), DOUBLE: re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S), NAME: re.compile(rb"[^`]*+`"),
    LINE: re.compile(rb"[^\n]*+\n"), LINE_SOME: re.compile(rb"[^\n]*+\n"), BLOCK: re.compile(rb".*?\*/", re.S), BLOCK_SOME: re.compile(rb".*?\*/", re.S),
}
_BLANK = re.compile(rb"(?:\s++|--(?=[ \t\r\n])[^\n]*+\n|\#[^\n]*+\n|/\*(?!!).*?\*/)*+", re.S)
_TOKENS = re.compile(
    rb"""(?:[^'"`\#/-]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`]*+`|--(?=[ \t\r\n])[^\n]*+\n|-(?!-[ \t\r\n])|\#[^\n]*+\n|/\*.*?\*/|/(?!\*))*+""", re.S
)
_OPENED = {ord("'"): SINGLE, ord('"'): DOUBLE, ord("`"): NAME, ord("-"): LINE_SOME, ord("#"): LINE_SOME, ord("/"): BLOCK_SOME}


def advance(state: int, piece: bytes) -> int:
    """The state after a piece, which ends before a ';' or where no mark is half read."""
    at = 0
    if state > SOME:
        m = _CLOSE[state].match(piece)
        if not m:
            return state
        at, state = m.end(), _AFTER[state]
    if state == PLAIN:
        at = _BLANK.match(piece, at).end()
        if at == len(piece):
            return PLAIN
        c = piece[at]
        if c == 35 or c == 45 and piece[at + 1 : at + 2] == b"-" and piece[at + 2 : at + 3] in (b" ", b"\t", b"\r", b"\n"):
            return LINE
        if piece.startswith(b"/*", at) and not piece.startswith(b"/*!", at):
            return BLOCK
    at = _TOKENS.match(piece, at).end()
    return SOME if at == len(piece) else _OPENED[piece[at]]


def left_at_end(state: int) -> bool:
    """Whether what is held in this state when the text ends is a statement."""
    return state not in (PLAIN, LINE)


_HALF = re.compile(rb"[\\/*-]*\Z")


class Splitter:
    """Statements of a text that comes in chunks; every byte is read once, however long a statement grows."""

    def __init__(self) -> None:
        self.state, self.parts, self.half = PLAIN, [], b""
        self.open_at_end = False

    def feed(self, chunk: str | bytes, last: bool = False) -> list[str]:
        data = chunk if isinstance(chunk, bytes) else chunk.encode("utf-8", "surrogatepass")
        return [s.decode("utf-8", "surrogatepass") for keep, s in self.cut(data, last) if keep]

    def cut(self, chunk: bytes, last: bool = False) -> Iterator[tuple[bool, bytes]]:
        """All that ends in the chunk, statements and stretches of space and comments alike: whether it is a statement, and its bytes."""
        data = self.half + chunk
        # A mark that may be half of one waits for the other half.
        end = len(data) if last else _HALF.search(data).start()
        data, self.half = data[:end], data[end:]
        *whole, rest = data.split(b";")
        for piece in whole:
            self.state = advance(self.state, piece)
            self.parts.append(piece + b";")
            if self.state in (PLAIN, SOME):
                yield self._end(self.state == SOME)
        self.state = advance(self.state, rest)
        self.parts.append(rest)
        if last:
            #: Whether the text ended inside quotes or a comment.
            self.open_at_end = self.state not in (PLAIN, SOME, LINE, LINE_SOME)
            yield self._end(left_at_end(self.state) and any(self.parts))

    def _end(self, keep: bool) -> tuple[bool, bytes]:
        statement = b"".join(self.parts)
        self.state, self.parts = PLAIN, []
        return keep, statement


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", ";").text(path)
    return read.select(meta.file_path.alias("source"), meta.file_block_start.alias("block"), meta.file_size.alias("file_size"), F.col("value").cast("binary").alias("piece"))


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], int, Iterator[bytes]]]:
    """The splits of a task in turn: source and place, size of the file, pieces."""
    rows = ((r for x in parts for r in zip(x.source, x.block, x.file_size, x.piece, strict=True)))
    for key, own in groupby(rows, key=lambda r: (r[0], r[1], r[2])):
        yield (key[0], int(key[1])), int(key[2]), (bytes(r[3]) for r in own)


def _maps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a split: for every state it may begin in the state after it, statements ended and the place after the last of them."""
    for (source, block), file_size, pieces in _blocks(parts):
        now, ended, last = list(STATES), [0] * len(STATES), [-1] * len(STATES)
        size = 0
        for piece in pieces:
            after = {s: advance(s, piece) for s in set(now)}
            size += len(piece) + 1
            for k in STATES:
                now[k] = after[now[k]]
                if now[k] in (PLAIN, SOME):
                    ended[k] += now[k] == SOME
                    last[k], now[k] = size, PLAIN
        yield pd.DataFrame([(source, block, file_size, size, now, ended, last)], columns=["source", "block", "file_size", "size", "after", "ended", "last"])


def read_statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source, stmt_no, byte_start, byte_end, sql of dump files, cut at top-level ';'.

    Leading comments and space stay with the statement that follows; a statement that the file does not end has no ';' (in a
    compressed file it has one, as its true size is not known, and such a file is read by one task).
    """
    # Statements are long: batches are bounded by bytes too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    schema = "source string, block long, file_size long, size long, after array<int>, ended array<long>, last array<long>"
    found = _pieces(spark, path).mapInPandas(_maps, schema).collect()
    begin: dict[tuple[str, int], tuple[int, int, int, int, bool | None]] = {}
    for source, blocks in groupby(sorted(found, key=lambda r: (r.source, r.block)), key=lambda r: r.source):
        own = list(blocks)
        missing = own[0].file_size - sum(r.size for r in own)
        packed = source.endswith((".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate"))
        # A byte order mark is passed over by the reader.
        at = 3 if not packed and missing in (2, 3) else 0
        state, number, start = PLAIN, 0, at
        for r in own:
            closed = None if r is not own[-1] else packed or missing in (0, 3)
            begin[source, r.block] = (state, at, number, start, closed)
            start = at + r.last[state] if r.last[state] >= 0 else start
            number += r.ended[state]
            at, state = at + r.size, r.after[state]

    sent = spark.sparkContext.broadcast(begin)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for key, _, pieces in _blocks(parts):
            state, at, number, start, closed = held[key]
            rows, size, parts_of = [], 0, []
            whole = start == at  # the statement begins in this split

            def row(stmt_no: int | None, whole: bool) -> tuple:
                return (key[0], stmt_no, start, at, None if whole else key[1], b"".join(parts_of))

            ahead = next(pieces, None)
            while ahead is not None:
                piece, ahead = ahead, next(pieces, None)
                state = advance(state, piece)
                # The last piece of a file may have no ';' after it.
                final = ahead is None and closed is not None
                if final and not closed:
                    parts_of.append(piece)
                    at += len(piece)
                    if left_at_end(state):
                        rows.append(row(number, whole))
                    elif not whole:
                        rows.append(row(None, False))
                    parts_of = []
                    break
                parts_of.append(piece + b";")
                at += len(piece) + 1
                if state in (PLAIN, SOME):
                    if state == SOME:
                        rows.append(row(number, whole))
                        number += 1
                    start, state, whole, parts_of = at, PLAIN, True, []
                elif final:
                    # Quotes or a comment that nothing ends.
                    if left_at_end(state):
                        rows.append(row(number, whole))
                    parts_of = []
                size += len(piece)
                if size > 8 << 20:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, size = [], 0
            if parts_of:
                rows.append(row(None, False))
            yield pd.DataFrame(rows, columns=COLUMNS)

    shape = "source string, stmt_no long, byte_start long, byte_end long, block long, data binary"
    rows = _pieces(spark, path).mapInPandas(cut, shape)
    # Both parts read the file; only pieces at borders, two a split at most, go through a shuffle.
    pieces = rows.where("block IS NOT NULL").groupBy("source", "byte_start")
    pieces = pieces.agg(F.max("stmt_no").alias("stmt_no"), F.max("byte_end").alias("byte_end"), F.sort_array(F.collect_list(F.struct("block", "data"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    out = ["source", "stmt_no", "byte_start", "byte_end"]
    whole = rows.where("block IS NULL").select(*out, "data")
    return whole.unionByName(pieces.where("stmt_no IS NOT NULL").select(*out, joined.alias("data"))).select(*out, F.col("data").cast("string").alias("sql"))


COLUMNS = ["source", "stmt_no", "byte_start", "byte_end", "block", "data"]
