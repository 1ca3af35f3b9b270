"""SQL text as rows: statements of a dump, and cells of INSERT and UPDATE statements."""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.encode import may_hold_url
from tidewater.sources.dumpfile import Splitter, read_statements

__all__ = ["Splitter", "cells", "parse", "parsed", "places", "read_statements", "rewrite_statement", "rewritten", "scanned", "shaped", "split", "statements"]

#: Up to the next ';' outside quotes and comments, in one match; two quotes inside a string end it and begin the next.
_STATEMENT = re.compile(
    r"""(?:[^'"`;#/-]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`]*+`|--(?=[ \t\r\n]|\Z)[^\n]*+|-|\#[^\n]*+|/\*.*?\*/|/(?!\*))*+;""",
    re.S,
)
_COMMENTS = re.compile(r"(?:\s|--(?=[ \t\r\n]|\Z)[^\n]*|#[^\n]*|/\*(?!!).*?\*/)*", re.S)


def split(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, statement), cut at top-level ';'. Leading comments and space stay with the statement that follows."""
    start = 0
    # Without a match the rest has no end, or a quote or comment that does not: it is one statement.
    while m := _STATEMENT.match(text, start):
        if _COMMENTS.match(text, start).end() < m.end() - 1:
            yield start, m.end(), m[0]
        start = m.end()
    if start < len(text) and _COMMENTS.match(text, start).end() < len(text):
        yield start, len(text), text[start:]


_NAME = r"(?:`((?:[^`]|``)*)`|([A-Za-z_$][\w$]*))"
_INSERT = re.compile(rf"\s*(INSERT|REPLACE)\s+(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\s+)*(?:INTO\s+)?{_NAME}\s*\(((?:`(?:[^`]|``)*`|[^)`])*)\)\s*VALUES?\s*", re.I)
_UPDATE = re.compile(rf"\s*UPDATE\s+(?:(?:LOW_PRIORITY|IGNORE)\s+)*{_NAME}\s+SET\s+", re.I)
_CELL = re.compile(
    r"""\s*(?:(?P<null>NULL\b)|(?P<convert>CONVERT\s*\(\s*)?FROM_BASE64\s*\(\s*'(?P<b64>[^']*)'\s*\)(?(convert)\s+USING\s+\w+\s*\))|(?P<text>_?\w*'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+")|(?P<hex>0x[0-9A-Fa-f]+|[xX]'[0-9A-Fa-f]*')|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<other>\w+))\s*""",
    re.I | re.S,
)
_ESCAPE = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "b": "\b"}


def unquoted(literal: str) -> str:
    q = literal[-1]
    body = literal[literal.index(q) + 1 : -1]
    return re.sub(r"\\(.)|" + q * 2, lambda m: _ESCAPE.get(m[1], m[1]) if m[1] else q, body, flags=re.S)


def decoded(text: str) -> str | None:
    """Text of a base64 payload; null if it is not base64."""
    try:
        return base64.b64decode(text, validate=True).decode("utf-8", "surrogateescape")
    except ValueError:
        return None


def _cell(m: re.Match[str]) -> tuple[str, str | None]:
    if m["null"]:
        return "null", None
    if m["b64"] is not None:
        return "base64", decoded(m["b64"])
    if m["text"]:
        return "string", unquoted(m["text"])
    return ("hex", m["hex"]) if m["hex"] else ("number", m["number"]) if m["number"] else ("other", m["other"])


_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+"|`(?:[^`]|``)*`|--(?=[ \t\r\n]|\Z)[^\n]*|\#[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|\S""", re.S)


def _plain(name: str) -> str:
    return name[1:-1].replace("``", "`") if name[:1] == "`" else name


def places(sql: str) -> tuple[str, list[tuple[int, int, int, str | None]]] | None:
    """The table, and (start, end, row, column) of every value of an INSERT, REPLACE or UPDATE in order; null for other shapes.

    Values are told by commas outside parentheses of their own, so they may be any expression. Assignments,
    of UPDATE or after ON DUPLICATE KEY UPDATE, have row -1; a value beyond the named columns has none.
    """
    lead = _COMMENTS.match(sql).end()
    if m := _INSERT.match(sql, lead):
        table, mode, columns = m[2] or m[3] or "", "values", [_plain(x[0]) for x in re.finditer(_NAME, m[4])]
    elif m := _UPDATE.match(sql, lead):
        table, mode, columns = m[1] or m[2] or "", "set", []
    else:
        return None
    out: list[tuple[int, int, int, str | None]] = []
    depth, row, column, start, name = 0, -1, 0, None, None

    def end(at: int) -> None:
        nonlocal start, column, name
        if start is not None:
            out.append((start, at, row if mode == "values" else -1, name if mode == "set" else columns[column] if column < len(columns) else None))
        start, column, name = None, column + 1, None

    for t in _TOKEN.finditer(sql, m.end()):
        s = t[0]
        if s == "(":
            depth += 1
            if depth == 1 and mode == "values":
                row, column, start = row + 1, 0, t.end()
        elif s == ")":
            if depth == 1 and mode == "values":
                end(t.start())
            depth -= 1
        elif depth == (1 if mode == "values" else 0) and s == ",":
            end(t.start())
            if mode == "values":
                start = t.end()
        elif depth == 0:
            word = s.upper()
            if mode == "values" and word == "ON":
                mode = "after"
            elif mode == "after" and word == "UPDATE":
                mode, start, name = "set", None, None
            elif mode == "set":
                if s == ";" or word in ("WHERE", "ORDER", "LIMIT"):
                    end(t.start())
                    mode = "rest"
                elif s == "=" and start is None:
                    start = t.end()
                elif start is None and (s[0] == "`" or s[0].isalpha() or s[0] in "_$"):
                    name = _plain(s)
    if mode == "set":
        end(len(sql))
    return table.replace("``", "`"), out


def cells(sql: str) -> list[dict] | None:
    """Cells of an INSERT, REPLACE or UPDATE: table, row, column, kind, value and place; null for other shapes.

    A value that is no plain literal is of kind ``expression``.
    """
    found = places(sql)
    if found is None:
        return None
    table, ranges = found
    inserts = any(row >= 0 for _, _, row, _ in ranges)
    out = []
    for start, end, row, column in ranges:
        if inserts and row < 0:
            continue
        if column is None:
            return None
        c = _CELL.fullmatch(sql, start, end)
        kind, value = _cell(c) if c else ("expression", sql[start:end].strip())
        out.append({"table": table, "row_no": max(row, 0), "column": column, "kind": kind, "value": value, "start": c.start("b64") if c else -1, "end": c.end("b64") if c else -1})
    return out or None


# Columns that hold block markup.
MARKUP = {
    ("posts", "post_content"), ("posts", "post_content_filtered"), ("posts", "post_excerpt"),
    ("comments", "comment_content"), ("term_taxonomy", "description"),
}


def hint(table: str, column: str, prefix: str = "wp_", own: dict[tuple[str, str], str] | None = None) -> str | None:
    """Content type of a column, by prefixed or bare table name; a caller's own hints go first."""
    bare = table.removeprefix(prefix)
    for t in (table, bare):
        if own and (t, column) in own:
            return own[t, column]
    return "block_markup" if (bare, column) in MARKUP else None


_PAYLOAD = re.compile(r"""\bFROM_BASE64\s*\(\s*'([^']*)'\s*\)|'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+"|`(?:[^`]|``)*`|--(?=[ \t\r\n]|\Z)[^\n]*|\#[^\n]*|/\*.*?\*/""", re.I | re.S)
_CALL = re.compile("from_base64", re.I)


def _may_hold_url(sql: str) -> bool:
    """Whether base64 of ``http``, at any of its three places, may stand in the text."""
    at = sql.find("dH")
    while at >= 0:
        if sql[at + 2 : at + 4] in ("A6", "Bz", "Rw"):
            return True
        at = sql.find("dH", at + 1)
    return "aHR0" in sql


def rewrite_statement(sql: str, edit: Callable[[str, str | None], str], own: dict[tuple[str, str], str] | None = None) -> str:
    """The statement with edited base64 payloads, wherever they stand; ``edit`` takes text and content type. The rest stays byte for byte.

    A payload in a value of a known column, alone or inside an expression, has that column's content type.
    """
    if not _may_hold_url(sql) or not _CALL.search(sql):
        return sql
    table, ranges = places(sql) or ("", [])
    begins, spots = [r[0] for r in ranges], []
    for m in _PAYLOAD.finditer(sql):
        if m[1] is not None:
            k = bisect.bisect_right(begins, m.start()) - 1
            column = ranges[k][3] if k >= 0 and m.end() <= ranges[k][1] else None
            spots.append((m.start(1), m.end(1), decoded(m[1]), hint(table, column, own=own) if column else None))
    out, last = [], 0
    for a, b, value, content in spots:
        if value is None or "http" not in value:
            continue
        new = edit(value, content)
        if new != value:
            out += [sql[last:a], base64.b64encode(new.encode("utf-8", "surrogateescape")).decode()]
            last = b
    return "".join([*out, sql[last:]]) if out else sql


def statements(texts: DataFrame) -> DataFrame:
    """source, stmt_no, byte_start, byte_end, sql of a table of source, value (whole texts)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            rows = []
            for source, value in zip(x.source, x.value, strict=True):
                at, seen = 0, 0
                for n, (a, b, sql) in enumerate(split(value or "")):
                    at += len(value[seen:a].encode("utf-8", "surrogatepass"))
                    size = len(sql.encode("utf-8", "surrogatepass"))
                    rows.append((source, n, at, at + size, sql))
                    at, seen = at + size, b
            yield pd.DataFrame(rows, columns=["source", "stmt_no", "byte_start", "byte_end", "sql"])

    return texts.mapInPandas(run, "source string, stmt_no long, byte_start long, byte_end long, sql string")


_CELLS = "array<struct<table:string,row_no:int,column:string,kind:string,value:string>>"
_B64 = "FROM_BASE64\\('[A-Za-z0-9+/=]*'\\)"
#: The statements of a dump's producer, for the JVM: the head, a name of its list, and a cell. Every match is short, so no stack grows with the text.
_HEAD = "^INSERT INTO `((?:[^`]|``)*)` \\(((?:`(?:[^`]|``)*`(?:, )?)+)\\) VALUES\n(?=\\()"
_COLUMN = "`((?:[^`]|``)*)`"
_VALUE = f"(?<=[(,])(?:NULL|''|-?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?|{_B64}|CONVERT\\({_B64} USING utf8mb4\\))(?=[,)])"


def scanned(sql: Column) -> Column:
    """What ``parsed`` gives, by built-in expressions alone, of a statement just as a dump's producer writes it; null of any other.

    The cells that the pattern finds are put together again as the producer would; only if that is the statement, byte for byte, were they its cells.
    """
    head = F.regexp_extract(sql, _HEAD, 0)
    names = F.regexp_extract_all(F.regexp_extract(sql, _HEAD, 2), F.lit(_COLUMN), F.lit(1))
    names = F.transform(names, lambda c: F.replace(c, F.lit("``"), F.lit("`")))
    values = F.regexp_extract_all(F.substring(sql, F.length(head), F.length(sql)), F.lit(_VALUE), F.lit(0))
    table = F.replace(F.regexp_extract(sql, _HEAD, 1), F.lit("``"), F.lit("`"))

    def rows(x: Column) -> Column:
        of = lambda r: F.concat(F.lit("("), F.array_join(F.slice(x["values"], r * F.size(x.names) + 1, F.size(x.names)), ","), F.lit(")"))
        return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(x["values"]) / F.size(x.names) - 1).cast("int")), of), ",\n")

    def cell(x: Column, v: Column, i: Column) -> Column:
        code = F.regexp_extract(v, "FROM_BASE64\\('([A-Za-z0-9+/=]*)'", 1)
        b64 = F.contains(v, F.lit("FROM_BASE64"))
        kind = F.when(v == "NULL", "null").when(b64, "base64").when(v == "''", "string").otherwise("number")
        value = F.when(b64, F.make_valid_utf8(F.try_to_binary(code, F.lit("base64")).cast("string"))).when(v == "''", "").when(v != "NULL", v)
        n = F.size(x.names)
        return F.struct(x.table.alias("table"), F.floor(i / n).cast("int").alias("row_no"), F.element_at(x.names, (i % n + 1).cast("int")).alias("column"), kind.alias("kind"), value.alias("value"))

    def whole(x: Column) -> Column:
        fits = (F.size(x.names) > 0) & (F.size(x["values"]) > 0) & (F.size(x["values"]) % F.greatest(F.size(x.names), F.lit(1)) == 0)
        same = F.when(fits, F.concat(x.head, rows(x), F.lit(";")) == x.sql)
        return F.when(same, F.transform(x["values"], lambda v, i: cell(x, v, i)))

    # A list of one, so that what is found is found once and named inside.
    found = F.array(F.struct(sql.alias("sql"), head.alias("head"), table.alias("table"), names.alias("names"), values.alias("values")))
    return F.transform(found, whole)[0].cast(_CELLS)


def parse(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``cells``: as ``parsed`` gives them. Only statements that the JVM's scan passes over go to Python."""
    # Not deterministic to Spark, so that no filter on the cells is moved below the function and calls it where it cannot be.
    rest = _parser().asNondeterministic()
    return statements.withColumn("cells", scanned(F.col(sql))).withColumn("cells", F.coalesce("cells", rest(F.when(F.col("cells").isNull(), F.col(sql)))))


def shaped(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """table, columns, shape, kinds, params of every row of INSERT statements: what a prepared statement is told by, and what is bound to it.

    A shape has a letter a value: ``i`` for whole numbers, ``r`` for others, ``s`` for all else. Rows that hold an expression have no shape.
    """
    cells = parse(statements.withColumn("_id", F.monotonically_increasing_id()), sql).select("_id", F.expr("sequence(0, size(cells) - 1)").alias("_n"), "cells")
    cells = cells.select("_id", F.explode(F.filter(F.arrays_zip(F.col("_n").alias("n"), F.col("cells").alias("c")), lambda x: x.c.isNotNull())).alias("x"))
    letter = F.when(F.col("x.c.kind") == "number", F.when(F.rlike(F.col("x.c.value"), F.lit("[.eE]")), "r").otherwise("i")).when(F.col("x.c.kind").isin("null", "string", "base64"), "s").otherwise("?")
    rows = cells.groupBy("_id", F.col("x.c.table").alias("table"), F.col("x.c.row_no").alias("row_no"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("x.n", F.col("x.c.column").alias("column"), letter.alias("letter"), F.col("x.c.kind").alias("kind"), F.col("x.c.value").alias("value")))).alias("v"))
    shape = F.array_join(F.transform("v", lambda x: x.letter), "")
    return rows.select("table", F.transform("v", lambda x: x.column).alias("columns"), F.when(~F.contains(shape, F.lit("?")), shape).alias("shape"), F.transform("v", lambda x: x.kind).alias("kinds"), F.transform("v", lambda x: x.value).alias("params"))


def parsed(sql: Column) -> Column:
    """array of (table, row_no, column, kind, value) of an INSERT or UPDATE; empty for other shapes. Bytes that are no text are U+FFFD in a value."""
    return _parser()(sql)


def _parser():
    def valid(v: str | None) -> str | None:
        return v if v is None or v.isascii() else v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{k: valid(c[k]) if k == "value" else c[k] for k in ("table", "row_no", "column", "kind", "value")} for c in cells(t) or []] if isinstance(t, str) else [])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, _CELLS)


def rewritten(dump: DataFrame, mapping: list[tuple[str, str]], sql: str = "sql") -> DataFrame:
    """Statements with the URLs in their payloads moved by the mapping (from, to), by order."""
    from tidewater.functions.nested import Rewriter

    edit = Rewriter(mapping)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: rewrite_statement(t, edit.value) if isinstance(t, str) else None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    # Statements that can hold no URL stay in the JVM.
    moved = F.pandas_udf(run, "string")(F.when(may_hold_url(F.col(sql)), F.col(sql)))
    return dump.withColumn(sql, F.coalesce(moved, sql))
