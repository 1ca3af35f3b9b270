"""Reports over scores, changes, statements and texts: small aggregates that Spark combines on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import encode, paths
from tidewater.operators.lineage import cut


def best_scored(df: DataFrame, group: Sequence[str], name: str, score: str, order: str, least: float = 0.5, other: str = "other") -> DataFrame:
    """group columns, name, score: the name of highest score per group, the first by ``order`` among equals; ``other`` and 0 where none reaches ``least``."""
    good = F.when(F.col(score) >= least, F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(name).alias("n")))
    found = df.groupBy(*group).agg(F.max(good).alias("b"))
    return found.select(*group, F.coalesce("b.n", F.lit(other)).alias(name), F.coalesce("b.s", F.lit(0.0)).alias(score))


def open_changes(log: DataFrame, key: str, seq: str, settled: Column) -> DataFrame:
    """key, changes: rows of a key after its last settled one; keys with none are left out.

    The last settled row of a key is aggregated first, so no task holds all rows of one.
    """
    marked = log.select(key, seq, F.coalesce(settled, F.lit(False)).alias("_ok"))
    last = marked.where("_ok").groupBy(key).agg(F.max(seq).alias("_last"))
    later = marked.join(last, key, "left").where(F.col("_last").isNull() | (F.col(seq) > F.col("_last")))
    return later.groupBy(key).agg(F.count("*").alias("changes"))


def newlines(text: Column, stop: int | None = None) -> Column:
    """Line feeds in the text, or in its first ``stop`` bytes; 0 for null."""
    if stop is not None:
        # Each byte is one character here, so a character cut in two is no matter.
        text = F.decode(F.substring(text.cast("binary"), 1, stop), "ISO-8859-1")
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long")


def sorted_domains(origins: DataFrame, column: str = "origin", known: Sequence[str] = ()) -> DataFrame:
    """domains: distinct origins, with those ``known`` before, as one sorted JSON array. The origins of a site are few."""
    rows = origins.select(F.col(column).alias("o")).where("o IS NOT NULL")
    if known:
        rows = rows.unionByName(origins.sparkSession.createDataFrame([(k,) for k in known], "o string"))
    return rows.distinct().agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("domains"))


def largest_first(sizes: Mapping[str, Column]) -> Column:
    """Names by size, the largest first; equal sizes keep the given order, null sizes are last."""
    found = F.array(*[F.struct(-F.coalesce(s, F.lit(-1)).cast("long").alias("n"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, s) in enumerate(sizes.items())])
    return F.transform(F.array_sort(found), lambda x: x["name"])


def hinted(columns: DataFrame, hints: Mapping[tuple[str, str], str], table: str = "tab", column: str = "col", prefix: str = "wp_") -> DataFrame:
    """Add ``kind``: the content type of (table, column), by full table name first, then without the prefix; null where unknown."""
    name = lambda t: F.concat(t, F.lit("\0"), F.col(column))
    known = F.create_map(*[F.lit(x) for (t, c), kind in sorted(hints.items()) for x in (f"{t}\0{c}", kind)])
    bare = F.when(F.startswith(table, F.lit(prefix)), F.substring(F.col(table), F.lit(len(prefix) + 1), F.length(table)))
    return columns.withColumn("kind", F.coalesce(F.try_element_at(known, name(F.col(table))), F.try_element_at(known, name(bare))))


def statement_counts(statements: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """by, statements, inserts, payloads, bytes of the statements of dumps."""
    insert = F.rlike("sql", F.lit(r"(?is)^(?:\s|--[^\n]*|#[^\n]*|/\*(?!!).*?\*/)*(INSERT|REPLACE)\b"))
    return statements.groupBy(*by).agg(
        F.count("*").alias("statements"),
        F.count_if(insert).alias("inserts"),
        F.count_if(insert & F.contains("sql", F.lit("FROM_BASE64("))).alias("payloads"),
        F.coalesce(F.sum(F.octet_length("sql")), F.lit(0)).alias("bytes"),
    )


def gzip_batches(files: DataFrame, by: Sequence[str], path: str = "path", head: str | None = None) -> DataFrame:
    """by, gzip: whether a batch of files is worth compressing: some file is, by its extension or, where that tells nothing, its first bytes; never with a null path."""
    kind = paths.compressible(F.col(path))
    text = F.coalesce(encode.is_text(F.col(head)), F.lit(False)) if head else F.lit(False)
    worth = F.coalesce((kind == "yes") | (kind == "unknown") & text, F.lit(False))
    return files.groupBy(*by).agg((F.bool_or(worth) & F.bool_and(F.col(path).isNotNull())).alias("gzip"))


def row_names(shaped: DataFrame) -> DataFrame:
    """table, row_id, option_name of rows as ``sqltext.shaped`` gives them: how a report names a row.

    The id is the first value where that is a number, a short string or NULL; the option's name is the second value where that is text.
    """
    kind, value = F.col("kinds")[0], F.col("params")[0]
    short = (kind == "string") & (F.length(value) <= 30)
    id_ = F.when(kind == "number", F.concat(F.lit("pk="), F.regexp_extract(value, "^-?[0-9]+", 0))).when(short, F.concat(F.lit("pk="), value)).when(kind == "null", "pk=NULL").otherwise("offset=?")
    second = F.when(F.try_element_at("kinds", F.lit(2)).isin("string", "base64"), F.try_element_at("params", F.lit(2)))
    return shaped.select("table", id_.alias("row_id"), second.alias("option_name"))


def changed_since(index: DataFrame, now: DataFrame, key: str = "path", stamp: str = "ctime") -> DataFrame:
    """key, error, expected, actual: rows of an index that are missing, or have another stamp, when looked at again."""
    later = now.select(F.col(key).alias("_k"), F.col(stamp).alias("_s"), F.lit(True).alias("_there"))
    joined = index.join(later, F.col(key) == F.col("_k"), "left")
    error = F.when(F.col("_there").isNull(), "file_missing").when(~F.col(stamp).eqNullSafe(F.col("_s")), "file_changed")
    return joined.select(key, error.alias("error"), F.col(stamp).alias("expected"), F.col("_s").alias("actual")).where("error IS NOT NULL")


def leaves(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """key, path, value (as JSON text) of every scalar, and every empty list or object, of JSON documents, as deep as they go; a text that is no JSON has none."""
    level = docs.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(doc)).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        text = F.to_json("v")
        open_ = F.startswith(text, F.lit("{")) & (text != "{}") | F.startswith(text, F.lit("[")) & (text != "[]")
        flat = level.where(~open_).select("key", "path", text.alias("value"))
        out = flat if out is None else out.unionByName(flat)
        level = cut(level.where(open_))
        if not level.limit(1).count():
            return out
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "name"))
        level = inner.select("key", F.concat("path", step).alias("path"), F.col("inner").alias("v"))


def drift(before: DataFrame, after: DataFrame, key: str, doc: str) -> DataFrame:
    """key, path, op, old, new: what was added, removed or changed between two tables of JSON documents, by key and path."""
    old, new = (leaves(d, key, doc).withColumnRenamed("value", name) for d, name in ((before, "old"), (after, "new")))
    both = old.join(new, ["key", "path"], "full_outer")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "change")
    return both.select("key", "path", op.alias("op"), "old", "new").where("op IS NOT NULL")
