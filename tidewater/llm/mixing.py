"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's target over its size.
Within the source these are prefix-summed in the order of size, one random offset is added, and a
document is emitted once per integer boundary its interval crosses. Sorted by size, neighbours are
alike, so the words taken stay within about the largest document of the target. So that a few large documents do not
take a source far from its target, those of over a ``COARSE`` part of it, the ``LARGE`` largest at most, have whole
expected copies: from the largest down, each as many of the two whole numbers around the rate as bring the words taken nearest to the rate's share
so far. What they leave of the target is the others' to take.

Nothing needs a source in one task: rows are range-partitioned by (source, size, doc_id), counted by
partition, and start from the count of the partitions before. Offsets come from a hash of the
source, so reruns agree.

Defined cases: a null text has size 0; a null source is a source, the last; a source of size 0 has
target 0 and no copies; an empty table gives no rows; repeated rows are documents of their own;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

#: Weights by the rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes, and the most copies of a source.
TOTAL, MOST = 1.5, 2.0
SEED = 20
#: Documents of over this part of the target, and so many of a source, are taken in whole copies.
COARSE, LARGE = 1 / 64, 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], within: list[str], name: str) -> DataFrame:
    """Add ``rank`` (from 1) of each row in ``order`` among the rows of the same ``within``; ``order`` leads with it.

    A staged range partitioning and the counts of its parts stand in for one sort in one task.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = staged(parts, name)
    counts = parts.groupBy("_part", *within).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = Window.partitionBy("_part", *within).orderBy(*order)
    numbered = parts.withColumn("_here", F.row_number().over(here))
    on = numbered["_part"] == counts["_part"]
    for c in within:
        on &= numbered[c].eqNullSafe(counts[c])
    hint = maybe_broadcast(counts)
    return numbered.join(hint, on).select(*[numbered[c] for c in df.columns], (F.col("_here") + F.col("_before")).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """Add ``target`` to rows with source and source_size. Water is filled by weight; a full source leaves its excess to the rest."""
    s = ranked(sizes.withColumn("_all", F.lit(0)), [F.col("_all"), F.col("source").isNull(), F.col("source")], ["_all"], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = staged(s.select(*sizes.columns, weight.alias("weight")), "mix-weights")
    goal = TOTAL * float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = None, F.lit(False)
    while True:
        left = s.where(~full)
        held = s.where(full).agg(F.coalesce(F.sum(MOST * F.col("source_size")), F.lit(0.0))).first()[0]
        weights, free = left.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
        if not free:
            break
        level = (goal - held) / weights
        over = MOST * F.col("source_size") < F.lit(level) * F.col("weight")
        if s.where(over & ~full).limit(1).count() == 0:
            break
        full = full | over
    capped = MOST * F.col("source_size").cast("double")
    even = F.lit(level if level is not None else 0.0) * F.col("weight")
    return s.select(*sizes.columns, F.when(full, capped).otherwise(even).alias("target"))


def plan(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row."""
    rows = docs.select(F.col("doc_id"), F.col("source"), (size_of(F.col("text")) if size is None else size).alias("size"))
    order = [F.col("source"), F.col("size"), F.col("doc_id")]
    rows = staged(ranked(rows, order, ["source"], "mix-rows"), "mix-ranked")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aim = targets(sizes).withColumnRenamed("source", "_source")
    r = rows.join(maybe_broadcast(aim), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    r = r.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    large = (F.col("rank") > F.col("n") - LARGE) & (F.col("size") > F.col("target") * COARSE) & (F.col("target") > 0)
    held = ["source", "source_size", "target", "rate"]
    # LARGE rows a source at most.
    v = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("k"), "size", "doc_id"))).alias("v")
    first = r.where(large).groupBy(*held).agg(v)

    def step(a: Column, x: Column) -> Column:
        share = a["share"] + F.col("rate") * x["size"]
        near = F.floor((share - a["words"]) / x["size"] + 0.5).cast("double")
        c = F.greatest(F.floor("rate").cast("double"), F.least(F.ceil("rate").cast("double"), F.lit(MOST), near)).cast("long")
        return F.struct(share.alias("share"), (a["words"] + c * x["size"]).alias("words"), F.concat(a["copies"], F.array(c)).alias("copies"))

    begin = F.struct(F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("words"), F.array().cast("array<bigint>").alias("copies"))
    first = staged(first.withColumn("w", F.aggregate("v", begin, step)), "mix-large")
    out = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"]
    whole = first.select(*held, F.explode(F.arrays_zip("v", F.col("w.copies").alias("copies"))).alias("x")).select(*held, "x.v.doc_id", "x.v.size", "x.copies")
    # What is left of the target and of the words.
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    left = first.select(F.col("source").alias("_source"), (F.col("target") - F.col("w.words")).alias("_goal"), (F.col("source_size") - size).alias("_words"))
    rest = r.where(~large).join(maybe_broadcast(left), F.col("source").eqNullSafe(F.col("_source")), "left")
    goal, words = F.coalesce("_goal", "target"), F.coalesce("_words", "source_size")
    rate = F.when(words > 0, F.least(F.lit(MOST), F.greatest(F.lit(0.0), goal / words))).otherwise(0.0)
    # The offset: a number in [0, 1) drawn by source, of 20 bits so that whole rates stay whole.
    name = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("source").isNull(), "|null|").otherwise("|"), F.lit(str(SEED)))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    end = F.floor(F.col("rank") * rate + offset)
    begins = F.floor((F.col("rank") - 1) * rate + offset)
    copies = F.least(end - begins, F.lit(int(MOST))).cast("long")
    return whole.select(*out).unionByName(rest.withColumn("copies", copies).select(*out))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the number of the copy (``copy``, or ``copy_`` where that name is taken)."""
    key = ["_id", "_source", "_size"]
    rows = plan(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    # Rows that agree in id, source and size share their copies: as many each, and what is left over to the first by a hash of the text.
    per = rows.groupBy(*key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    per = staged(per.select(*key, F.floor(F.col("_copies") / F.col("_rows")).alias("_each"), (F.col("_copies") % F.col("_rows")).alias("_more")), "mix-copies")
    d = docs.select(F.struct("*").alias("_d"), F.col("doc_id").alias("_own_id"), F.col("source").alias("_own_source"), size_of(F.col("text")).alias("_own"))
    on = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_size"))
    name = "copy"
    while name in docs.columns:
        name += "_"
    # As many rows as the mix has documents: never broadcast, however small the table at hand is.
    taken = d.join(per.where("_more = 0").hint("merge"), on).select("_d", "_each")
    uneven = per.where("_more > 0")
    if uneven.limit(1).count():
        shared = d.join(maybe_broadcast(uneven), on).select("_d", *key, F.xxhash64("_d.text").alias("_turn"), "_each", "_more")
        shared = ranked(shared, [F.col(c) for c in (*key, "_turn")], key, "mix-shared")
        each = F.col("_each") + F.when(F.col("rank") <= F.col("_more"), 1).otherwise(0)
        taken = taken.unionByName(shared.select("_d", each.alias("_each")).where("_each > 0"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_each").cast("int"))).alias(name)
    return taken.select("_d", copies).select("_d.*", name)
