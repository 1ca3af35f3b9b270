"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first, calibrated widening.

The tree is fitted on a bounded sample; every vector is then indexed at a leaf. A query walks the
tree through a priority queue (nodes in the order of their centre's inner product with the query)
and visits the first leaves it meets. How many is calibrated: sampled queries are held against brute
force over all vectors, and the number of visits is widened until the mean share of true neighbours
in visited leaves reaches the target. Scores of what is visited are exact, in double precision.

Equal vectors are indexed once, with their ``top`` + 1 smallest ids, which is all that a result can
name. Large leaves are cut into cells by a hash, and the queries of a leaf that many ask for into chunks, so
no task holds a whole leaf or all that ask for it, and a leaf is copied only as its own queries demand.

Defined cases: null, zero, ragged (not of the commonest length) vectors and such with null or
non-finite components take no part, nor do rows without an id; ties go to the smaller id; repeated
ids are rows of their own, so another row of the query's id is a candidate; fewer candidates than ``top`` are all returned; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

TOP = 20
EVERY = 20
#: The tree: most rows of the sample, branches of a node, rows of the sample at which a node is a leaf.
SAMPLE, BRANCH, LEAF_SAMPLE = 20_000, 8, 96
#: Calibration: queries, and the share of their true neighbours to be reached.
CALIBRATE, RECALL = 100, 0.95
#: Vectors of a cell, and queries of a cell.
CELL = 8192


@dataclass
class Tree:
    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every step."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves by best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                continue
            for s, k in zip((-(self.centres[kids] @ q)).tolist(), kids, strict=True):
                heapq.heappush(queue, (s, k))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    """Label of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(turns):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return near


def grow(x: np.ndarray, seed: int = 3) -> Tree:
    """Split the sample by k-means until nodes are small or all alike."""
    rng = np.random.default_rng(seed)
    tree, centres = Tree(np.zeros((0, 0))), [x.mean(0)]
    tree.children.append([])
    tree.leaf.append(-1)
    todo = [(0, x)]
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) > LEAF_SAMPLE:
            near = kmeans(rows, min(BRANCH, len(rows)), rng)
            parts = [rows[near == j] for j in range(BRANCH) if (near == j).any()]
        if len(parts) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for p in parts:
            tree.children[node].append(len(centres))
            todo.append((len(centres), p))
            centres.append(p.mean(0))
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centres = np.array(centres)
    return tree


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floats stay floats, all else are doubles) of the rows that take part."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = v.where(~bad & F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (size["d"] if size else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def best(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, top: int, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` best rows. Sums run in one order whatever the block, so ties are exact."""
    rough = rows @ q if rough is None else rough
    k = min(top, len(rough))
    if k < len(rough):
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= floor - 1e-9 * (1 + abs(floor)))
    else:
        near = np.arange(k)
    exact = (rows[near] * q).sum(1)
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def _brute(queries: np.ndarray, names: np.ndarray):
    """Blocks of vectors -> each sampled query's best of the block, with the leaf they are indexed at."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            m, ids, leaf = _matrix(x.v), x.vec_id.to_numpy(), x.leaf.to_numpy()
            out = []
            for n, q in zip(names, queries, strict=True):
                keep = ids != n
                if keep.any():
                    at, s = best(m[keep], ids[keep], q, TOP)
                    out.append(pd.DataFrame({"q": n, "vec_id": ids[keep][at], "leaf": leaf[keep][at], "score": s}))
            yield pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "leaf": [], "score": []}).astype({"q": int, "vec_id": int, "leaf": int})

    return run


def calibrate(indexed: DataFrame, tree: Tree, target: float = RECALL) -> int:
    """Leaf visits at which sampled queries reach the target recall against brute force over all vectors."""
    asked = indexed.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(CALIBRATE).collect()
    names, queries = np.array([r.vec_id for r in asked]), np.array([r.v for r in asked], np.float64)
    found = indexed.select("vec_id", "v", "leaf").mapInPandas(_brute(queries, names), "q long, vec_id long, leaf int, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    truth = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP).select("q", "leaf").collect()
    if not truth:
        return 1
    # Visits needed for each true neighbour: the turn at which its leaf is met.
    turn = {n: {leaf: i + 1 for i, leaf in enumerate(tree.visit(q, tree.leaves))} for n, q in zip(names.tolist(), queries, strict=True)}
    need = np.sort([turn[r.q][r.leaf] for r in truth])
    visits = 1
    while visits < tree.leaves and np.searchsorted(need, visits, side="right") < target * len(need):
        visits += 1
    return visits


def _score(top: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"rep": [], "near": [], "score": []}).astype({"rep": int, "near": int})
        m, ids = _matrix(vectors.v), vectors.vec_id.to_numpy()
        near, score, size = [], [], []
        # Rough scores by one product for some queries at a time.
        for at in range(0, len(queries), 256):
            asked = _matrix(queries.v.iloc[at : at + 256])
            for q, rough in zip(asked, asked @ m.T, strict=True):
                place, exact = best(m, ids, q, top, rough)
                near.append(ids[place])
                score.append(exact)
                size.append(len(place))
        return pd.DataFrame({"rep": np.repeat(queries.rep.to_numpy(), size), "near": np.concatenate(near), "score": np.concatenate(score)})

    return run


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    rows = staged(valid(vectors), "ann-rows")
    # Equal vectors: the smallest ids of each, under a number of their own, a hash of the vector.
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top + 1)
    unique = staged(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("uid", F.xxhash64("v")), "ann-unique")
    sample = unique.select("uid", "v").orderBy("uid").limit(SAMPLE).select("v").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    kind = rows.schema["v"].dataType.simpleString()
    tree = grow(np.array([r.v for r in sample], np.float64))
    sent = spark.sparkContext.broadcast(tree)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            if len(x):
                yield x.assign(leaf=sent.value.assign(_matrix(x.v)))

    indexed = unique.select(F.col("uid").alias("vec_id"), "v").mapInPandas(place, f"vec_id long, v {kind}, leaf int")
    indexed = staged(indexed, "ann-index")
    visits = calibrate(indexed, tree, recall)
    # Cells of a leaf: one number a leaf, so the table is no larger than the tree.
    cells = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cells = maybe_broadcast(cells)
    held = indexed.join(cells, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int").alias("cell"), "vec_id", "v")

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            if len(x):
                seen = [sent.value.visit(q, visits) for q in _matrix(x.v)]
                yield pd.DataFrame({"rep": x.vec_id, "v": x.v, "leaf": seen}).explode("leaf").astype({"leaf": "int32"})

    # Vectors that some query has: a query per distinct vector.
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    of = staged(asked.join(unique.select("v", F.col("uid").alias("rep")), "v").select(F.col("vec_id").alias("query_id"), "rep"), "ann-queries")
    routed = indexed.join(of.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "v")
    routed = staged(routed.mapInPandas(route, f"rep long, v {kind}, leaf int"), "ann-routed")
    # Chunks of queries by leaf, as many as its own queries fill.
    chunks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    held = held.join(maybe_broadcast(chunks), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    routed = routed.join(cells, "leaf").join(maybe_broadcast(chunks), "leaf")
    chunk = F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("chunks")).cast("int").alias("chunk")
    routed = routed.select("leaf", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), chunk, "rep", "v")
    at = ["leaf", "cell", "chunk"]
    scored = held.groupBy(*at).cogroup(routed.groupBy(*at)).applyInPandas(_score(top + 1), "rep long, near long, score double")
    nearest = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    scored = scored.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= top + 1)
    # From distinct vectors to rows: at most (top + 1) ** 2 a query vector.
    full = scored.join(unique.select(F.col("uid").alias("near"), "ids"), "near").select("rep", "near", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    full = full.withColumn("n", F.row_number().over(by_row)).where(F.col("n") <= top + 1)
    lists = full.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "near"))).alias("found"))
    # The query's own row goes, once.
    own = F.array_position(F.transform("found", lambda x: (x.vec_id == F.col("query_id")) & (x.near == F.col("rep"))), True)
    own = of.join(lists, "rep").select("query_id", F.filter("found", lambda x, i: i + 1 != own).alias("found"))
    out = own.select("query_id", F.posexplode(F.slice("found", 1, top)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
