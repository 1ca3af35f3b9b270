"""A table as the fragments of a SQL dump, and dumps applied to a database."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import encode
from tidewater.sources import sqltext

# What a dump sets before its rows and restores after them.
HEADER = (
    "SET @OLD_UNIQUE_CHECKS=@@UNIQUE_CHECKS, UNIQUE_CHECKS=0;\n"
    "SET @OLD_FOREIGN_KEY_CHECKS=@@FOREIGN_KEY_CHECKS, FOREIGN_KEY_CHECKS=0;\n"
    "SET @OLD_SQL_MODE=@@SQL_MODE, SQL_MODE='ONLY_FULL_GROUP_BY,ERROR_FOR_DIVISION_BY_ZERO,NO_ENGINE_SUBSTITUTION';\n"
    "SET AUTOCOMMIT=0;"
)
FOOTER = "\nCOMMIT;\nSET SQL_MODE=@OLD_SQL_MODE;\nSET FOREIGN_KEY_CHECKS=@OLD_FOREIGN_KEY_CHECKS;\nSET UNIQUE_CHECKS=@OLD_UNIQUE_CHECKS;"

#: Sections of a dump in the order in which they take effect.
SECTIONS = ("header", "structure", "rows", "updates", "footer")
#: Cells whose literal is shorter than this never leave their row.
LEAST_SPLIT = 1000

_COLUMN_TYPES = {
    T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
    T.BooleanType: "TINYINT(1)", T.DateType: "DATE", T.TimestampType: "DATETIME(6)", T.TimestampNTZType: "DATETIME(6)", T.BinaryType: "LONGBLOB",
}


def create_table(df: DataFrame, table: str, key: Sequence[str], lengths: dict[str, int] | None = None) -> str:
    """CREATE TABLE for the schema; text of a key has the length of its longest value in ``lengths`` (191 where not given), as an index needs one."""
    lines, lengths = [], lengths or {}
    for f in df.schema:
        kind = _COLUMN_TYPES.get(type(f.dataType), "LONGTEXT")
        if isinstance(f.dataType, T.DecimalType):
            kind = f"DECIMAL({f.dataType.precision},{f.dataType.scale})"
        if f.name in key and kind in ("LONGTEXT", "LONGBLOB"):
            kind = f"VARCHAR({max(191, lengths.get(f.name, 0))})" if kind == "LONGTEXT" else f"VARBINARY({max(767, lengths.get(f.name, 0))})"
        lines.append(f"  {encode.quote(f.name)} {kind}" + ("" if f.nullable and f.name not in key else " NOT NULL"))
    if key:
        lines.append(f"  PRIMARY KEY ({', '.join(map(encode.quote, key))})")
    return f"CREATE TABLE {encode.quote(table)} (\n" + ",\n".join(lines) + "\n);"


def _row_size(df: DataFrame) -> Column:
    size = F.lit(len(df.columns) + 3).cast("long")
    for f in df.schema:
        size = size + encode.encoded_size(F.col(encode.quote(f.name)), f.dataType)
    return size


def split_columns(df: DataFrame, key: Sequence[str], limit: int, chunk: int) -> Column:
    """Names of the cells that leave a row of more than ``limit`` bytes: the largest first, until what stays fits.

    Only text and bytes of more than ``chunk`` bytes leave, and never the key.
    """
    cells = [
        F.struct((-encode.encoded_size(F.col(encode.quote(f.name)), f.dataType)).alias("size"), F.lit(i).alias("at"), F.lit(f.name).alias("name"), F.coalesce(F.octet_length(encode.quote(f.name)) > chunk, F.lit(False)).alias("long"))
        for i, f in enumerate(df.schema)
        if f.name not in key and isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    none = F.array().cast("array<string>")
    if not cells:
        return none

    def step(a: Column, x: Column) -> Column:
        out = F.struct((a["excess"] + x["size"] + 2).alias("excess"), F.concat(a["names"], F.array(x["name"])).alias("names"))
        return F.when(a["excess"] > 0, out).otherwise(a)

    fit = F.filter(F.array_sort(F.array(*cells)), lambda x: x["long"] & (x["size"] <= -LEAST_SPLIT))
    return F.aggregate(fit, F.struct((_row_size(df) - limit).alias("excess"), none.alias("names")), step)["names"]


def fragments(df: DataFrame, table: str, key: Sequence[str], batch: int = 250, limit: int = 16 << 20, json: Sequence[str] = ()) -> DataFrame:
    """section, part, stmt_no, sql: the whole dump of a table, in parts of the key's order.

    A row of more than ``limit`` bytes has '' for its largest cells, and UPDATEs append their pieces; without
    a key such a row is an error. Equal keys are in no set order.
    """
    spark = df.sparkSession
    chunk = max(64, (limit - 512) * 3 // 4)
    name = encode.quote(table).replace("\n", "\\n")
    texts = [f.name for f in df.schema if f.name in key and isinstance(f.dataType, (T.StringType, T.BinaryType))]
    longest = df.agg(*[F.max(F.length(encode.quote(c))).alias(c) for c in texts]).first().asDict() if texts else {}
    longest = {c: n for c, n in longest.items() if n}
    # How a dump opens a table.
    structure = f"--\n-- Table structure for table {name}\n--\n\nDROP TABLE IF EXISTS {encode.quote(table)};\n{create_table(df, table, key, longest)}"
    fixed = spark.createDataFrame([(0, 0, 0, HEADER), (1, 0, 0, structure), (4, 0, 0, FOOTER)], "section int, part int, stmt_no long, sql string")
    schema = "section int, part int, stmt_no long, sql string"
    if not key:
        message = f"a row of {table} is over {limit} bytes and has no primary key"
        first = df.columns[0]
        checked = df.withColumn(first, F.when(_row_size(df) > limit, F.raise_error(F.lit(message)).cast(df.schema[first].dataType)).otherwise(F.col(encode.quote(first))))
        rows = encode.insert_statements(checked, table, df.columns, batch, json=json)
        return fixed.unionByName(rows.select(F.lit(2).alias("section"), "part", "stmt_no", "sql")).to(_schema(schema))
    out = split_columns(df, key, limit, chunk)
    marked = df.withColumn("_out", out)
    short = [F.when(F.array_contains("_out", f.name), F.lit("").cast(f.dataType)).otherwise(F.col(encode.quote(f.name))).alias(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) and f.name not in key else F.col(encode.quote(f.name)) for f in df.schema]
    rows = encode.insert_statements(marked.select(*short), table, list(key), batch, json=json)
    return (
        fixed.unionByName(rows.select(F.lit(2).alias("section"), "part", "stmt_no", "sql"))
        .unionByName(_updates(marked.where(F.size("_out") > 0), df.schema, table, key, chunk, json))
        .to(_schema(schema))
    )


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def _updates(rows: DataFrame, schema: T.StructType, table: str, key: Sequence[str], chunk: int, json: Sequence[str]) -> DataFrame:
    """Pieces of the cells in ``_out``, numbered within parts of the key's order."""
    where = F.concat_ws(" AND ", *[encode.equals(k, schema[k].dataType) for k in key])
    cells = [
        F.when(F.array_contains("_out", f.name), F.struct(F.lit(i).alias("at"), F.lit(encode.quote(f.name)).alias("name"), F.col(encode.quote(f.name)).cast("binary").alias("d"), F.lit(f.name in json).alias("json")))
        for i, f in enumerate(schema)
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    if not cells:
        return rows.sparkSession.createDataFrame([], "section int, part int, stmt_no long, sql string")
    k = F.struct(*[F.col(encode.quote(c)).alias(f"k{i}") for i, c in enumerate(key)]).alias("k")
    each = rows.select(k, where.alias("where"), F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL")
    last = F.floor((F.octet_length("c.d") - 1) / chunk).cast("int")
    pieces = each.select("k", "where", "c.at", "c.name", "c.json", "c.d", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    piece = F.concat(F.lit("FROM_BASE64('"), encode.to_base64(F.substring("d", F.col("n") * chunk + 1, F.lit(chunk))), F.lit("')"))
    piece = F.when(F.col("json"), F.concat(F.lit("CONVERT("), piece, F.lit(" USING utf8mb4)"))).otherwise(piece)
    sql = F.concat(F.lit(f"UPDATE {encode.quote(table)} SET "), "name", F.lit(" = CONCAT("), "name", F.lit(", "), piece, F.lit(") WHERE "), "where", F.lit(";"))
    sized = pieces.select("k", "at", "n", sql.alias("sql")).repartitionByRange("k").withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy("k", "at", "n")) - 1
    return sized.select(F.lit(3).alias("section"), "part", number.cast("long").alias("stmt_no"), "sql")


def write_dump(rows: DataFrame, path: str) -> None:
    """The fragments as text files; one after another by name, they are the dump."""
    order = ("section", "part", "stmt_no")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("sql").write.text(path)


LEDGER = "tidewater_applied"


def _session(sql: str) -> bool:
    """Whether a statement tells its connection something, and nothing to the database."""
    return sql.split(None, 1)[0].upper().rstrip(";") in ("SET", "COMMIT") if sql.strip() else True


def _staged(rows: DataFrame, folder: str) -> DataFrame:
    """What a whole earlier write left in the folder; ``rows``, written there, where none did."""
    spark = rows.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def apply(rows: DataFrame, connect: Callable[[], Any], run: str, stage: str, every: int = 100, session: bool = True, execute: Callable[[Any, str], Any] | None = None) -> None:
    """Run the statements of ``fragments`` on a database: section by section, parts side by side, each in its order.

    ``connect`` gives a DB-API connection whose statements are in a transaction until committed. The header and the footer
    are run on every connection; ``session`` false leaves out what only sets a connection up (SET, COMMIT), for targets
    that have no such statements. A row may hold several statements; they are run one by one, by ``execute`` where given.

    The statements are written to ``stage`` first, a folder that all executors share, and a later call with the same folder
    takes them from there: rows are not dealt into other statements then. Every ``every`` statements are committed together with their names in a ledger, a table of the database: a
    digest of the statement and which of its like it is. So a task that is tried again, or the whole job under the same
    ``run``, passes over what is committed, however the rows are parted or numbered.
    """
    do = execute or (lambda cursor, sql: cursor.execute(sql))
    rows = _staged(rows.select("section", "part", "stmt_no", "sql"), stage)
    tag = run.replace("'", "''")
    wanted = lambda sql: [s for _, _, s in sqltext.split(sql) if session or not _session(s)]
    frame = [[s for r in rows.where(F.col("section") == k).orderBy("part", "stmt_no").select("sql").collect() for s in wanted(r.sql)] for k in (0, len(SECTIONS) - 1)]
    con = connect()
    con.cursor().execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (run VARCHAR(191), name VARCHAR(80), PRIMARY KEY (run, name))")
    con.commit()
    con.close()

    def task(part_rows: Iterator[Row]) -> None:
        ahead = list(islice(part_rows, every))
        if not ahead:
            return
        con = connect()
        cursor = con.cursor()
        try:
            for s in frame[0]:
                do(cursor, s)
            while ahead:
                names = ", ".join(f"'{r.name}'" for r in ahead)
                cursor.execute(f"SELECT name FROM {LEDGER} WHERE run = '{tag}' AND name IN ({names})")
                done = {r[0] for r in cursor.fetchall()}
                left = [r for r in ahead if r.name not in done]
                for r in left:
                    for s in wanted(r.sql):
                        do(cursor, s)
                if left:
                    cursor.execute(f"INSERT INTO {LEDGER} VALUES " + ", ".join(f"('{tag}', '{r.name}')" for r in left))
                con.commit()
                ahead = list(islice(part_rows, every))
            for s in frame[1]:
                do(cursor, s)
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    # Of statements that are alike any may count as the first: they do the same.
    digest = F.sha2(F.concat_ws(" ", F.col("section").cast("string"), "sql").cast("binary"), 256)
    like = F.row_number().over(Window.partitionBy("_digest").orderBy("part", "stmt_no"))
    named = rows.where(F.col("section").between(1, len(SECTIONS) - 2)).withColumn("_digest", digest).withColumn("name", F.concat_ws(".", "_digest", like.cast("string")))
    for section in range(1, len(SECTIONS) - 1):
        named.where(F.col("section") == section).repartition("part").sortWithinPartitions("part", "stmt_no").foreachPartition(task)


def apply_file(spark: SparkSession, path: str | list[str], mapping: list[tuple[str, str]], connect: Callable[[], Any], run: str, stage: str, every: int = 100, session: bool = True, stretch: int = 64 << 20, execute: Callable[[Any, str], Any] | None = None) -> None:
    """Read dump files, move their URLs, and apply them, as one job that goes on where it was stopped.

    Statements that set a session up are run on every connection; those that make or drop things come first, in the order of
    the files; then rows, in stretches of the file side by side, each in its order; then updates likewise.
    """
    read = sqltext.rewritten(sqltext.read_statements(spark, path), mapping)
    word = F.upper(F.regexp_extract(F.regexp_replace("sql", r"^(?:\s+|--[ \t\r\n][^\n]*\n?|#[^\n]*\n?|/\*(?!!)(?s:.*?)\*/)+", ""), r"^(?:/\*!\d* *)?([A-Za-z]+)", 1))
    rows = F.when(word.isin("SET", "COMMIT", "START", "LOCK", "UNLOCK", "USE"), -1).when(word.isin("INSERT", "REPLACE"), 2).when(word == "UPDATE", 3).otherwise(1)
    # One row a file: numbered by name.
    files = read.select("source").distinct().withColumn("_file", F.row_number().over(Window.orderBy("source")).cast("long") * 1_000_000)
    part = F.when(F.col("_section") == 1, 0).otherwise(F.col("_file") + F.floor(F.col("byte_start") / stretch))
    number = F.when(F.col("_section") == 1, F.col("_file").cast("long") * (1 << 40)).otherwise(F.lit(0)) + F.col("stmt_no")
    body = read.withColumn("_section", rows).where("_section > 0").join(F.broadcast(files), "source")
    body = body.select(F.col("_section").alias("section"), part.alias("part"), number.alias("stmt_no"), "sql")
    frame = spark.createDataFrame([(0, 0, 0, HEADER), (4, 0, 0, FOOTER)], "section int, part int, stmt_no long, sql string")
    apply(frame.unionByName(body), connect, run, stage, every, session, execute)
