"""Hard negatives by one-dimensional distance keys.

Components become floor(256 * x). Every vector gets one more component, so that all are equally long and a larger
inner product is a smaller distance. Vectors are stored sorted by (pivot, distance to it), the
nearest of a few pivots that k-means finds in a bounded sample. A vector at distance r from the query has a key
within r of the query's own distance to its pivot: the search scans key intervals in the order of that bound, a few blocks of
keys first, then four times as many in each round, until the bound of all that is left is beyond the last of the k
found. Then nothing better can be left, so results are exact. The search for negatives has an inner radius too, for the
scores above the band of a positive.

Keys are parted by a bin of the label, so positives are searched in one bin. A distinct vector of a
label is stored once, with the smallest ids of its rows, which are all that a result can name; blocks beyond ``CELL`` vectors are
cut by a hash, and the queries of a block that many ask for into chunks.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; a shorter vector counts as padded by zeros; repeated ids are rows of their own, only the anchor's own row is left out once; an anchor
with fewer positives or negatives has fewer rows; positives of negative score have no negatives, as no score is in their band; an empty
table gives no rows; extra columns are ignored. Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann_tree import kmeans
from .common import lookup, maybe_broadcast, small_batches, staged

SCALE = 256
#: Anchors are rows whose id this divides; positives of an anchor and negatives of a positive.
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: The band of a negative's score, in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Pivots, rows of the sample that sets them, bins of labels.
PIVOTS, SAMPLE, BINS = 16, 20_000, 16
#: Vectors of a block aimed at, most blocks, vectors and queries of a cell.
BLOCK, BLOCKS, CELL, CHUNK = 4096, 16_384, 32_768, 4096
#: Blocks of the first scan, and how many times as many each further one has.
FIRST, WIDEN = 8, 4
SALTS = 256
LONG = (1 << 63) - 1


def shifted(vectors: DataFrame) -> DataFrame:
    """The labels of rows whose id 7 divides move on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q and uid, the name of label and q, of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and label is not null and v is not null")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    q = F.concat(F.transform("v", lambda x: F.floor(x * SCALE)), F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    v = v.select("vec_id", "label", q.alias("q"))
    return v.withColumn("uid", F.md5(F.concat_ws(",", F.array_join("q", ","), "label").cast("binary")))


def distinct(rows: DataFrame, ids: int) -> DataFrame:
    """uid, label, q and the smallest ids of each distinct vector of a label; a group of any size is cut by a hash first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    w = Window.partitionBy("uid", "_salt").orderBy("vec_id")
    few = salted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ids)
    named = F.slice(F.sort_array(F.collect_list("vec_id")), 1, ids).alias("ids")
    out = few.groupBy("uid").agg(F.first("label").alias("label"), F.first("q").alias("q"), named)
    return out.withColumn("n2", F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


@dataclass
class Keys:
    """Pivots in the space of the longer vectors, and the blocks of keys: bin, pivot, and first and last distance of each."""

    pivots: np.ndarray
    longest: float
    number: np.ndarray
    bin: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distance(self, n2: float, score: float) -> float:
        """Distance from a query of squared length ``n2`` at which vectors have this score."""
        return max(n2 + self.longest - 2 * score, 0.0) ** 0.5

    def order(self, q: np.ndarray, own: int | None, inner: float) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of bin ``own``, or of all, that reach beyond the inner radius, by their bound; and the bounds."""
        d = np.sqrt(((self.pivots[:, :-1] - q) ** 2).sum(1) + self.pivots[:, -1] ** 2)[self.pivot]
        bound = np.maximum(0.0, np.maximum(d - self.high, self.low - d))
        keep = d + self.high >= inner * (1 - 1e-9) - 1e-6
        if own is not None:
            keep &= self.bin == own
        at = np.flatnonzero(keep)
        at = at[np.lexsort((self.number[at], bound[at]))]
        return self.number[at], bound[at]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def longer(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))[:, None]])


def keyed(unique: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Keys] | None:
    """The distinct vectors with their block and cell, stored sorted by (bin, pivot, distance), and the directory of blocks."""
    rows, longest = unique.agg(F.count("*"), F.max("n2")).first()
    if not rows:
        return None
    sample = np.array([r.q for r in unique.select("uid", "q").orderBy("uid").limit(SAMPLE).collect()], np.float64)
    sample = longer(sample, longest)
    near = kmeans(sample.copy(), min(PIVOTS, len(sample)), np.random.default_rng(12))
    pivots = np.array([sample[near == k].mean(0) for k in np.unique(near)])

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            if len(x):
                m = longer(_matrix(x.q), longest)
                d = np.stack([np.sqrt(((m - p) ** 2).sum(1)) for p in pivots], 1)
                at = d.argmin(1)
                yield pd.DataFrame({"uid": x.uid, "pivot": at.astype(np.int32), "far": d[np.arange(len(m)), at], "label": x.label, "q": x.q, "ids": x.ids})

    schema = "uid string, pivot int, far double, label string, q array<long>, ids array<long>"
    part = F.pmod(F.xxhash64("label"), F.lit(BINS)).cast("int").alias("bin")
    far = staged(unique.select("uid", "label", "q", "ids").mapInPandas(measure, schema).select("*", part), "hard-far")
    # As many slices of each bin and pivot: their borders are quantiles of the distance.
    slices = max(1, min(-(-rows // (block * BINS * len(pivots))), BLOCKS // (BINS * len(pivots))))
    borders = [i / slices for i in range(1, slices)]
    cuts = F.percentile_approx("far", borders, 10_000) if borders else F.array().cast("array<double>")
    cuts = F.broadcast(far.groupBy("bin", "pivot").agg(cuts.alias("cuts")))
    number = (F.col("bin") * len(pivots) + F.col("pivot")) * slices + F.size(F.filter("cuts", lambda c: F.col("far") > c))
    far = far.join(cuts, ["bin", "pivot"]).withColumn("block", number.cast("int")).drop("cuts")
    # At most BLOCKS rows.
    blocks = far.groupBy("block", "bin", "pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).orderBy("block").collect()
    field = lambda name, kind: np.array([r[name] for r in blocks], kind)
    keys = Keys(pivots, longest, field("block", int), field("bin", int), field("pivot", int), field("low", float), field("high", float))
    cells = unique.sparkSession.createDataFrame([(r.block, -(-r.n // CELL)) for r in blocks], "block int, cells int")
    cell = F.pmod(F.xxhash64("uid"), F.col("cells")).cast("int").alias("cell")
    index = far.join(F.broadcast(cells), "block").select("bin", "pivot", "far", "block", cell, "cells", "uid", "label", "q", "ids")
    return staged(index.repartitionByRange("bin", "pivot", "far").sortWithinPartitions("bin", "pivot", "far"), "hard-index"), keys


def band(score: int, least: int, most: int) -> tuple[int, int]:
    """Lowest and highest whole score of a negative of a positive with this score."""
    return -(-least * score // 100), most * score // 100


def _asks(bands: bool, least: int, most: int):
    """The score ranges that a query's list of positive scores asks for; without ``bands`` any score."""
    return lambda scores: [band(int(s), least, most) for s in scores] if bands else [(-LONG, LONG)]


def _scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of whole numbers of both, held within a long."""
    size = lambda a: max(int(a.max()), -int(a.min())) if a.size else 0
    if m.shape[1] * size(m) * size(q) < 1 << 53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return np.clip(q.astype(object) @ m.T.astype(object), -LONG, LONG).astype(np.int64)


def _best(k: int, same: bool, asks):
    """Vectors and queries of a cell -> the first ``k`` distinct vectors of every score range asked for."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            m, label = _matrix(vectors.q), vectors.label.to_numpy()
            first, names, ids = np.array([i[0] for i in vectors.ids]), vectors.uid.to_numpy(), vectors.ids.to_numpy()
            kinds = {name: label == name for name in queries.label.unique()}
            for at in range(0, len(queries), 128):
                some = queries.iloc[at : at + 128]
                for uid, kind, positives, s in zip(some.uid, some.label, some.scores, _scores(m, _matrix(some.q)), strict=True):
                    open_ = np.flatnonzero(kinds[kind] if same else ~kinds[kind])
                    own = s[open_]
                    for ask, (low, high) in enumerate(asks(positives)):
                        at_ = open_[(own >= low) & (own <= high)]
                        if len(at_) > k:
                            floor = np.partition(s[at_], len(at_) - k)[len(at_) - k]
                            at_ = at_[s[at_] >= floor]
                        at_ = at_[np.lexsort((first[at_], -s[at_]))[:k]]
                        out += [(uid, ask, names[i], int(s[i]), ids[i]) for i in at_.tolist()]
        return pd.DataFrame(out, columns=["uid", "ask", "near", "score", "ids"])

    return run


def scan(queries: DataFrame, index: DataFrame, keys: Keys, k: int, same: bool, asks, name: str) -> DataFrame:
    """uid, ask, near, score, ids: the first ``k`` distinct vectors, by score and least id, of every score range a query asks for.

    ``queries`` has uid, label, q, n2, scores and bin. Rounds of expanding key intervals; a query is
    through when what is left cannot reach its last found.
    """
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(keys)
    schema = "uid string, ask int, near string, score long, ids array<long>"
    found = spark.createDataFrame([], schema)
    seen, most = 0, FIRST
    while seen < len(keys.number):
        last = found.groupBy("uid", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        last = last.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("ask", "least"))).alias("last"))

        def route(parts: Iterator[pd.DataFrame], seen: int = seen, most: int = most) -> Iterator[pd.DataFrame]:
            held = sent.value
            for x in parts:
                out = []
                for r in x.itertuples(index=False):
                    want = asks(r.scores)
                    if not want:
                        continue
                    done = dict(r.last) if r.last is not None else {}
                    reach = max(held.distance(r.n2, done.get(i, low)) for i, (low, _) in enumerate(want))
                    inner = min(held.distance(r.n2, high) for _, high in want)
                    number, bound = held.order(np.asarray(r.q, np.float64), r.bin if same else None, inner)
                    stop = np.searchsorted(bound, reach * (1 + 1e-9) + 1e-6, side="right")
                    out += [(r.uid, r.label, r.q, r.scores, b) for b in number[seen : min(stop, seen + most)].tolist()]
                yield pd.DataFrame(out, columns=["uid", "label", "q", "scores", "block"])

        asked = queries.join(last, "uid", "left").select("uid", "label", "q", "n2", "scores", "bin", "last")
        routed = staged(asked.mapInPandas(route, "uid string, label string, q array<long>, scores array<long>, block int"), f"{name}-routed")
        # At most BLOCKS rows.
        chunks = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
        if not routed.limit(1).count():
            break
        held = index.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cells = F.broadcast(index.groupBy("block").agg(F.first("cells").alias("cells")))
        chunk = F.pmod(F.xxhash64(F.lit(5), "uid"), F.col("chunks")).cast("int").alias("chunk")
        sent_to = routed.join(chunks, "block").join(cells, "block").select("*", chunk, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
        at = ["block", "cell", "chunk"]
        new = held.select(*at, "uid", "label", "q", "ids").groupBy(*at).cogroup(sent_to.select(*at, "uid", "label", "q", "scores").groupBy(*at))
        both = found.unionByName(new.applyInPandas(_best(k, same, asks), schema))
        w = Window.partitionBy("uid", "ask").orderBy(F.desc("score"), F.col("ids")[0])
        found = staged(both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"), f"{name}-found")
        seen, most = seen + most, most * WIDEN
    return found


def _rows(found: DataFrame, k: int) -> DataFrame:
    """uid, ask, n (from 1), id, score, near: the first ``k`` rows of what distinct vectors were found."""
    w = Window.partitionBy("uid", "ask").orderBy(F.desc("score"), "id", "near")
    rows = found.select("uid", "ask", "score", "near", F.explode("ids").alias("id"))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def mine(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose id ``every`` divides."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = quantised(vectors)
    unique = staged(distinct(rows, max(positives + 1, negatives)), "hard-unique")
    got = keyed(unique, block)
    if got is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index, keys = got
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("anchor_id"), "uid")
    asking = unique.join(maybe_broadcast(staged(anchors.select("uid").distinct(), "hard-asking")), "uid", "left_semi")
    bins = F.pmod(F.xxhash64("label"), F.lit(BINS)).cast("int").alias("bin")
    asking = staged(asking.select("uid", "label", "q", "n2", bins), "hard-queries")

    none = F.array().cast("array<long>").alias("scores")
    near = scan(asking.select("*", none), index, keys, positives + 1, True, _asks(False, least, most), "hard-positives")
    near = staged(_rows(near, positives + 1).select("uid", "n", "id", "score", (F.col("near") == F.col("uid")).alias("own")), "hard-near")
    scores = near.groupBy("uid").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    scores = scores.withColumn("scores", F.filter("scores", lambda s: s >= 0))
    hard = scan(asking.join(scores, "uid"), index, keys, negatives, False, _asks(True, least, most), "hard-negatives")
    hard = _rows(hard, negatives).join(scores, "uid").select("uid", F.col("scores")[F.col("ask")].alias("score"), F.struct("n", F.col("id"), F.col("score").alias("s")).alias("x"))
    hard = hard.groupBy("uid", "score").agg(F.sort_array(F.collect_list("x")).alias("hard"))
    # One row a distinct anchor vector, with its first positives and their negatives; the anchors' rows are joined last.
    lists = near.join(hard, ["uid", "score"], "left").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "own", "hard"))).alias("found"))
    out = lookup(anchors, staged(lists, "hard-lists"), "uid")
    own = F.array_position(F.transform("found", lambda x: (x.id == F.col("anchor_id")) & x.own), True)
    out = out.select("anchor_id", own.alias("own"), "found").select("anchor_id", F.filter("found", lambda x, i: i + 1 != F.col("own")).alias("found"))
    out = out.select("anchor_id", F.explode(F.slice("found", 1, positives)).alias("p")).select("anchor_id", "p", F.explode("p.hard").alias("x"))
    return out.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("x.n").cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("x.s").alias("negative_score"),
    )
