"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask of fixed places picks some words of a window and ignores the rest, so a window whose ignored
words were replaced still hashes alike. The windows of documents and of benchmark items are joined
by hash; each hit fixes a diagonal (document place minus item place), along which the item's words
are compared with the document's. A document is contaminated by an item when some stretch of
``SPAN`` item words (the whole item where it is shorter) agrees in ``AGREE`` of its words or more.

Words are lower-cased runs of letters, digits and what is beyond ASCII. The item side is joined by
broadcast only where its words, counted, are at most ``BROADCAST_WORDS``; beyond it Spark shuffles.

Short items are seeded by shorter masks, which documents are cut by only where such items are there.

Defined cases: a null or empty text or item has no windows and is clean; repeated rows, and ids repeated with other texts, are all compared; extra columns are ignored; an empty benchmark leaves all clean;
whole texts are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

#: Places of a window that a mask reads. Whatever 4 of 16 words are replaced, one of these masks reads only kept ones
#: somewhere in the 16; so for 3 of 15. Tests enumerate that.
MASKS = ((0, 1, 5, 7, 8), (0, 1, 4, 9, 10), (0, 2, 4, 5, 6))
#: The same for shorter items: (fewest words of an item, masks), each good up to the next; 3 of 11 to 14 words may be
#: replaced, then 2 of 8 to 10 (1 of 7), 1 of 4 to 6, and none of fewer.
CLASSES = ((1, ((0,),)), (2, ((0, 1),)), (7, ((0, 2, 3), (0, 3, 4))), (11, ((0, 1, 2, 5), (0, 3, 8, 9))), (15, MASKS))
SPAN = 16
AGREE = 0.75
#: Most words of all items together for which items and their seeds (at most one a mask and word) are broadcast.
BROADCAST_WORDS = 250_000


def words(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def windows(rows: DataFrame, keep: list[str], h: str, classes: list[int]) -> DataFrame:
    """``keep``, place and seed of every window that the masks of ``classes`` read in the words ``h``; the seed carries the mask.

    Each word is laid beside those after it once, for all masks; seeds are then plain columns, without a lambda a window.
    """
    masks = {10 * c + k: mask for c in classes for k, mask in enumerate(CLASSES[c][1])}
    places = sorted({m for mask in masks.values() for m in mask})
    beside = F.arrays_zip(*[F.slice(h, m + 1, F.size(h)).alias(f"w{m}") for m in places])
    w = rows.select(*keep, F.posexplode(beside).alias("p", "w"))
    # A mask that reaches beyond the last word reads no window there.
    seeds = [F.when(F.col(f"w.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"w.w{m}") for m in mask])) for k, mask in masks.items()]
    return w.select(*keep, "p", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def class_of(n: Column) -> Column:
    """Place in ``CLASSES`` of an item of ``n`` words; null for none."""
    return reduce(lambda found, c: F.when(n >= CLASSES[c][0], c).otherwise(found), range(len(CLASSES)), F.lit(None).cast("int"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key (of id and words), item_id, item (its words) and item_words of the distinct items."""
    b = benchmark.select("item_id", words(F.col("text")).alias("item"))
    return b.distinct().select(F.xxhash64("item_id", "item").alias("item_key"), "item_id", "item", F.size("item").alias("item_words"))


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Verified overlaps: ``keep`` columns of the document with item_id, item_words, agreed words, and the place in the document.

    Windows travel as (``keep``, place, seed) alone; the words of a document are read again, and only where
    a window hit, to compare them. So the work grows with the words of a text, not with their square.
    """
    items = staged(items_of(benchmark), "decontamination-items")
    total, classes = items.agg(F.coalesce(F.sum("item_words"), F.lit(0)), F.sort_array(F.collect_set(class_of(F.col("item_words"))))).first()
    small = F.broadcast if total <= BROADCAST_WORDS else (lambda df: df)
    # An item is cut by the masks of its own length. Without items, any class will do.
    classes = classes or [0]
    s = reduce(DataFrame.unionByName, [windows(items.where(class_of(F.col("item_words")) == c), ["item_key"], "item", [c]) for c in classes]).withColumnRenamed("p", "at")
    w = windows(docs.select(*keep, words(F.col("text")).alias("h")), keep, "h", classes)
    # The same diagonal is met by many windows: one row is enough.
    met = w.join(small(s), "seed").select(*keep, "item_key", (F.col("p") - F.col("at")).alias("diagonal")).distinct()
    met = staged(met, "decontamination-met").select(*[F.col(c).alias(f"_{c}") for c in keep], "item_key", "diagonal")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keep])
    near = docs.select(*{*keep, "text"}).join(maybe_broadcast(met.select(*[f"_{c}" for c in keep]).distinct()), same, "left_semi")
    near = staged(near.select(*keep, words(F.col("text")).alias("h")), "decontamination-near")
    met = near.join(met, same).drop(*[f"_{c}" for c in keep]).join(small(items), "item_key")
    # The document's words beside the item's; places beyond the document agree with nothing.
    agree = F.transform("item", lambda x, i: F.when(F.get(F.col("h"), F.col("diagonal") + i) == x, 1).otherwise(0))
    met = met.select(*keep, "item_id", "item_words", "diagonal", agree.alias("agree"))
    span = F.least(F.lit(SPAN), F.col("item_words"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.col("item_words") - span),
            lambda i: F.aggregate(F.slice("agree", i + 1, span), F.lit(0), lambda a, x: a + x),
        )
    )
    met = met.withColumn("span", span).withColumn("best", best).where(F.col("best") >= F.ceil(AGREE * F.col("span")))
    return met.groupBy(*keep, "item_id").agg(
        F.max("item_words").alias("item_words"),
        F.max(F.aggregate("agree", F.lit(0), lambda a, x: a + x)).alias("agreed_words"),
        F.min("diagonal").alias("first_place"),
        F.count_distinct("diagonal").alias("diagonals"),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item."""
    return hits(docs, benchmark, ["doc_id"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item overlaps, with their own columns.

    Rows go by their id and a hash of their text, so other rows of an id, and of no id, stay.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = hits(rows, benchmark, ["doc_id", "key"]).select(F.col("doc_id").alias("leak_id"), F.col("key").alias("leak_key")).distinct()
    found = staged(found, "decontamination-found")
    same = docs["doc_id"].eqNullSafe(found["leak_id"]) & (F.xxhash64(docs["text"]) == found["leak_key"])
    return docs.join(maybe_broadcast(found), same, "left_anti")
