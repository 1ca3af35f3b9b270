"""Record streams: file index, change log and work list as JSON lines; the contents of file trees by ranges."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import trees

INDEX = "path string, ctime long, size long, type string"
UPDATES = "op string, path string, ctime long, size long, type string"


def read_index(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """A file index; paths are base64 in the file, and a bad line stops the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("path", F.decode(F.unbase64("path"), "UTF-8"))


def write_index(df: DataFrame, path: str) -> None:
    df.withColumn("path", F.regexp_replace(F.base64(F.col("path").cast("binary")), "[\r\n]", "")).write.json(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder: path, ctime, size, type; empty and hidden ones too. Contents are not read."""
    return trees.scan(spark, [path]).where("type = 'file'").select("path", "ctime", "size", "type")


CHUNK = "path string, offset long, data binary, first boolean, last boolean, error string"


def contents(files: DataFrame, size: int = 1 << 20, stretch: int = 16 << 20) -> DataFrame:
    """Contents of listed files (path, size, ctime) in chunks of ``size`` bytes: path, offset, data, first, last, error.

    A file is read by as many tasks as shuffles have, a ``stretch`` at a time, and no task holds more than a few chunks. A stretch whose file is not as
    it was listed, before or after it is read, gives a row with ``error`` (file_missing, file_open, file_read or
    file_changed) at its place and nothing else counts of it; a null size or ctime is not compared. An empty file is one empty chunk.
    """
    stretch = max(size, stretch // size * size)
    known = files.select("path", F.col("size").cast("long").alias("size"), F.col("ctime").cast("long").alias("ctime")).where("path IS NOT NULL")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce("size", F.lit(0)) - 1, F.lit(0)).cast("long"), F.lit(stretch).cast("long"))
    # A fixed number: the list of ranges is small, so adaptive execution would join its partitions into one.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = known.withColumn("start", F.explode(starts)).repartition(tasks, "path", "start")
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def read(path: str, total: int | None, ctime: int | None, start: int) -> Iterator[tuple]:
        def changed(s: os.stat_result) -> bool:
            return total is not None and s.st_size != total or ctime is not None and int(s.st_ctime) != ctime

        try:
            f = open(path, "rb", buffering=0)
        except OSError as e:
            yield path, start, None, None, None, "file_missing" if isinstance(e, FileNotFoundError) else "file_open"
            return
        with f:
            before = os.fstat(f.fileno())
            end = total if total is not None else before.st_size
            stop = min(start + stretch, end) if total is not None else end
            at, error = start, "file_changed" if changed(before) else None
            while error is None and (at < stop or at == end == start == 0):
                try:
                    data = os.pread(f.fileno(), min(size, stop - at), at)
                except OSError:
                    error = "file_read"
                    break
                if len(data) < min(size, stop - at):
                    error = "file_changed"
                    break
                yield path, at, data, at == 0, at + len(data) == end, None
                at += len(data)
                if end == 0:
                    break
            after = os.fstat(f.fileno())
            if error is None and (after.st_size, after.st_mtime_ns, after.st_ctime_ns) != (before.st_size, before.st_mtime_ns, before.st_ctime_ns):
                error = "file_changed"
            if error:
                yield path, start, None, None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                held, rows = 0, []
                for row in read(r["path"], r["size"], r["ctime"], r["start"]):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held >= 8 << 20:
                        yield batch(rows)
                        held, rows = 0, []
                yield batch(rows)

    return ranges.select("path", "size", "ctime", "start").mapInArrow(run, CHUNK)


def whole_files(chunks: DataFrame) -> DataFrame:
    """Chunks of the files that no chunk has an error of."""
    bad = chunks.where("error IS NOT NULL").select("path").distinct()
    return chunks.where("error IS NULL").join(bad, "path", "left_anti").drop("error")
