"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator may broadcast after counting it.
BROADCAST_ROWS = 200_000
#: Most characters of all texts of a training sample.
SAMPLE_CHARS = 64_000_000
#: Rows of one key beyond which a join treats the key as hot.
HOT_ROWS = 1_000_000

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir``, or a temporary one in a session of one machine without it (tests); an error elsewhere."""
    global _local_root
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _local_root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote; only for tables that no returned plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing holds any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound Arrow batches by rows, and by bytes where this Spark can, so long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting at most ``limit`` + 1 rows; a larger table stays a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` with a staged table of one row a key. Keys that over ``hot`` rows of ``left`` have are joined by broadcast.

    So no task holds all rows of such a key, and what is broadcast has at most one row for ``hot`` of ``left``.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    many = staged(left.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > hot).select(on), "lookup-hot")
    if not many.limit(1).count():
        return left.join(right, on, how)
    held = left.join(F.broadcast(many), on, "left_semi").join(F.broadcast(right.join(F.broadcast(many), on, "left_semi")), on, how)
    return left.join(F.broadcast(many), on, "left_anti").join(right, on, how).unionByName(held)


def sieved(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join wide rows with a staged narrow table, inner, semi or anti, so that few wide rows are shuffled where it is too large to broadcast.

    A bitmap of hashed keys is broadcast: at least 16 bits a key, 2 ** 27 bits in all at most. Rows whose bit is not
    set have no partner; only the others, about one in 16 too many, are joined by shuffle.
    """
    if (count := right.count()) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    place = F.pmod(F.xxhash64(on), F.lit(1 << min(27, (16 * count).bit_length()))) + 1
    bucket, bit = F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")
    bits = right.select(bucket, bit).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    marked = left.select("*", bucket, bit).join(F.broadcast(bits), "_bucket", "left")
    marked = marked.select(*left.columns, F.coalesce(F.getbit(byte, F.expr("int(_bit % 8)")) == 1, F.lit(False)).alias("_may"))
    met = marked.where("_may").drop("_may").join(right, on, how)
    return met.unionByName(marked.where("not _may").drop("_may")) if how == "left_anti" else met


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, chars: int = SAMPLE_CHARS) -> list:
    """(text, label) of at most ``rows`` labelled documents, chosen by a hash of doc_id alone; texts of any length take part.

    Null labels and null texts are not drawn. Should the texts drawn have over ``chars`` characters in all, the
    last in order are left out.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & keep)
        .select("doc_id", F.col(label).cast("int").alias("_label"), F.xxhash64("doc_id", F.lit(17)).alias("_turn"))
        .orderBy("_turn", "doc_id", "_label")
        .limit(rows)
    )
    drawn = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    # Rows of one id share a turn, and so do repeated labels: the bound is set by turns.
    left, last = chars, None
    for turn, size in drawn.groupBy("_turn").agg(F.sum(F.length("text"))).orderBy("_turn").collect():
        left, last = left - size, turn
        if left < 0:
            break
    got = drawn.where(F.col("_turn") < F.lit(last)) if left < 0 else drawn
    return [(r.text, r._label) for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.text, r._label))]


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) with the smallest node that links reach, for nodes that have an edge.

    ``edges`` has longs ``a`` and ``b``. Every round takes the least label around a node and then
    jumps to the label of that label, so long chains close in few rounds; rounds are staged.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where("a <> b").distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), name)
    while True:
        beside = labels.select(F.col("node").alias("b"), "label")
        around = lookup(both, beside, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # The label of each label that some node has after the hook.
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        hooked = staged(hooked, f"{name}-hooked")
        used = staged(hooked.select("label").distinct().join(up, "label"), f"{name}-up")
        step = staged(lookup(hooked, used, "label").select("node", "was", F.least("label", "up").alias("label")), name)
        changed = step.where("was <> label").limit(1).count()
        unstage(labels, hooked, used)
        labels = step
        if not changed:
            unstage(both)
            return labels.select("node", "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
