"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Exact: every pair of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or
more is linked, and no other. Which rows of the matrix must meet is found from their first n-grams: in
one order of all n-grams, linked documents of n n-grams or more share k of their first n - ceil(0.75 n) + k,
whatever k is. With k = 1 + n / 12, a third of the n-grams is shuffled. The order is by length, longest
first, as short words are the frequent ones and n-grams of them meet by chance, the more the larger the
corpus; then by hash. N-grams that are frequent in the whole corpus come last. The order steers the work
alone, not the result. Documents of like size that share a first n-gram make a cell, named by the least of them.
Documents that share fewer than k of their first n-grams with all others leave; in the cells, signatures
of one bit an n-gram, summed modulo 2, then part those that cannot be linked: linked sets differ in
(a + b) / 7 n-grams at most, and signatures in no more bits than sets in n-grams. A cell inside another
is dropped. Inside a cell the product is taken block by block: overlap counts are added up n-gram by
n-gram and pairs below the bound that their sizes set,
overlap >= 3/7 (a + b), go. Blocks yield spanning links, never the pairs. In cells of more than one
block, blocks first meet themselves and the cell's first block; then only documents outside the
cell's largest class meet the others, and only where sizes allow a link. So a cell of near copies
costs about its size.

Only names, sizes and signatures of sets are stored. The texts are cut into n-grams twice: to count, and to
send first n-grams in the order that the counts set; and once more where a text's class is in a cell.

Copies (equal sets) are one class from the start. Links join classes into components.

Defined cases: a null or wordless text has size 0 and no link; fewer than five words make one
shingle; a null doc_id never names a component unless all its ids are null; repeated rows each get
their row; extra columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, lookup, maybe_broadcast, release, sieved, small_batches, staged, unstage

WIDTH = 5
#: Similarity 0.75 as a whole fraction.
NUM, DEN = 3, 4
#: Documents in a block of the product.
BLOCK = 256
#: First n-grams that one task groups.
ENTRIES = 2_000_000
#: Cells of so many rows are parted by signatures; larger ones go to the product as they are.
PART = 1024
#: An n-gram is frequent where one set in ``SHARE`` holds it and ``LEAST`` do, as counted in every run of ``CHUNK`` n-grams
#: where ``FEW`` or more sets do. Sets have a mean size, so there are at most ``SHARE`` times that many, however large the corpus.
SHARE, LEAST, CHUNK, FEW = 8192, 4, 4_000_000, 2
#: The lower bits of an n-gram's hash, which tell its length: 0 for the longest.
LENGTH = np.uint64(31)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, known: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text, their lengths in the lower bits."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w) & ~31 | min(len(w), 31)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > 500_000:
        known.clear()
    n = min(width, len(h))
    out, length = np.full(len(h) - n + 1, n, np.uint64), np.zeros(len(h) - n + 1, np.uint64)
    long = h & LENGTH
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        length += long[i : i + len(out)]
    return np.unique(out & ~LENGTH | LENGTH - np.minimum(length >> np.uint64(1), LENGTH))


def key_of(tokens: np.ndarray) -> int:
    """Signed 63-bit name of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def least_shared(n: np.ndarray) -> np.ndarray:
    """k: how many of their first n-grams linked sets share, ``n`` being the smaller's size."""
    return 1 + n // 12


def first_count(n: np.ndarray) -> np.ndarray:
    """How many n-grams of a set count as its first."""
    return n - (NUM * n + DEN - 1) // DEN + least_shared(n)


def packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of hashes, 6 bytes each."""
    return np.ascontiguousarray((tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(parts: list[bytes]) -> np.ndarray:
    """The 48-bit numbers of packed sets, one after another."""
    flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :6] = flat
    return out.view(np.uint64).ravel()


def signature(tokens: np.ndarray) -> bytes:
    """For each of a power of two of bits, n or more, whether an odd number of n-grams falls on it."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def folded(sign: bytes, size: int) -> np.ndarray:
    """A signature of ``size`` bytes, as 64-bit words, from one as long or longer."""
    x = np.frombuffer(sign, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def by_run(columns: tuple[str, ...], f):
    """Sorted partitions -> ``f`` of the columns of every run of rows that agree in ``columns``; one run is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            if held is not None:
                x = pd.concat([held, x], ignore_index=True)
            if not len(x):
                continue
            held, found = None, []
            v = {c: x[c].to_numpy() for c in x.columns}
            new = np.zeros(len(x), bool)
            for c in columns:
                new[1:] |= v[c][1:] != v[c][:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            for at, end in zip(cuts, cuts[1:]):
                found.append(f({c: a[at:end] for c, a in v.items()}))
            held = x.iloc[cuts[-1] :]
            if found:
                yield pd.concat(found, ignore_index=True)
        if held is not None:
            yield f({c: held[c].to_numpy() for c in held.columns})

    return run


def _sets(texts: pd.Series, known: dict[bytes, int], seen: set[int]):
    """(place, n, key, set or None) of texts; the set of a key is given once, as long as ``seen`` knows it."""
    for at, text in enumerate(texts):
        t = shingles(text, known)
        if not len(t):
            yield at, 0, None, None
            continue
        key = key_of(t)
        fresh = key not in seen
        if fresh:
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(key)
        yield at, len(t), key, t if fresh else None


class _Often:
    """Counts of the n-grams that ``FEW`` or more sets of a chunk hold."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0
        self.token, self.times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(tokens >> np.uint64(16))
        self.size += len(tokens)
        if self.size >= CHUNK:
            self.count()

    def count(self) -> None:
        if self.held:
            token, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.token.append(token[times >= FEW])
            self.times.append(times[times >= FEW])
            self.held.clear()
            self.size = 0
            if sum(map(len, self.token)) > 1_000_000:
                self.merge()

    def merge(self) -> None:
        token, back = np.unique(np.concatenate(self.token), return_inverse=True)
        times = np.bincount(back, np.concatenate(self.times), len(token)).astype(np.int64)
        self.token, self.times = [token], [times]


_NAMED = "doc_id long, th long, n long, key long, sign binary, often binary"


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """docs -> doc_id, hash of the text, n, key, and a signature once a key and task; a last row of n = -1 has the counts of frequent n-grams."""
    known, seen, often = {}, set(), _Often()
    for whole in batches:
        for at in range(0, len(whole), 500):
            docs, found = whole.iloc[at : at + 500], []
            for _, n, key, t in _sets(docs["text"], known, seen):
                if t is not None:
                    often.add(t)
                found.append((n, key, None if t is None else signature(t)))
            n, key, sign = zip(*found, strict=True)
            yield pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64").array, "th": docs["th"].array, "n": n, "key": pd.array(key, "Int64"), "sign": sign, "often": None})
    often.count()
    often.merge()
    last = np.concatenate([often.token[0].astype(np.int64), often.times[0]]).tobytes()
    none = pd.array([None], "Int64")
    yield pd.DataFrame({"doc_id": none, "th": none, "n": [-1], "key": none, "sign": [None], "often": [last]})


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        for v in x.often:
            token, times = np.frombuffer(v, np.int64).reshape(2, -1)
            yield pd.DataFrame({"token": token, "times": times})


def _firsts(sets: list[np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First n-grams of sets: (which set, n-gram, place among the frequent ones or -1)."""
    n = np.array([len(t) for t in sets], np.int64)
    token, row = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    length, token = (token & LENGTH).astype(np.int64), token >> np.uint64(16)
    place = np.full(len(token), -1, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
        place = np.where(hot[at] == token, at, -1)
    # Sets are sorted by hash already: short n-grams, then frequent ones, go to the end of their set.
    order = np.argsort(64 * row + 32 * (place >= 0) + length, kind="stable")
    rank = np.arange(len(token)) - (np.cumsum(n) - n)[row]
    keep = order[rank < first_count(n)[row]]
    return row[keep], token[keep], place[keep]


_PACKED = "bucket int, token binary, key binary, n binary, times binary"


def _spread(buckets: int, hot):
    """docs -> first n-grams by bucket, with the runs of keys and sizes they belong to; frequent ones, by place, are bucket -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = {}, set()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                met = [(n, key, t) for _, n, key, t in _sets(whole["text"].iloc[at : at + 1000], known, seen) if t is not None]
                if not met:
                    continue
                n, key = np.array([m[0] for m in met], np.uint32), np.array([m[1] for m in met], np.int64)
                row, token, place = _firsts([m[2] for m in met], hot.value)
                bucket = np.where(place < 0, (token % np.uint64(buckets)).astype(np.int64), -1)
                # Inside a bucket, 32 bits tell n-grams apart; where they do not, a set counts too much and is looked at in vain.
                token = np.where(place < 0, token // np.uint64(buckets), place.astype(np.uint64)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                row, token, bucket = row[order], token[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    runs = np.flatnonzero(np.r_[True, row[a + 1 : b] != row[a : b - 1]])
                    who = row[a:b][runs]
                    rows.append((int(bucket[a]), token[a:b].tobytes(), key[who].tobytes(), n[who].tobytes(), np.diff(np.r_[runs, b - a]).astype(np.uint16).tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "token", "key", "n", "times"])

    return run


def _entries(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows -> n-gram, key and size of each entry."""
    times = np.concatenate([np.frombuffer(r.times, np.uint16) for r in rows])
    key = np.repeat(np.concatenate([np.frombuffer(r.key, np.int64) for r in rows]), times)
    n = np.repeat(np.concatenate([np.frombuffer(r.n, np.uint32) for r in rows]), times).astype(np.int64)
    return np.concatenate([np.frombuffer(r.token, np.uint32) for r in rows]), key, n


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """docs -> key, n and packed n-grams, once a key and task."""
    known, seen = {}, set()
    for whole in batches:
        for at in range(0, len(whole), 500):
            rows = [(key, n, packed(t)) for _, n, key, t in _sets(whole["text"].iloc[at : at + 500], known, seen) if t is not None]
            yield pd.DataFrame(rows, columns=["key", "n", "tokens"]).astype({"key": "int64", "n": "int64"})


_FOUND = "g long, key long, n long"


def size_step(n: np.ndarray) -> np.ndarray:
    """Steps of size: sets can only be linked within a step, or from one to the next."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.int16)


def _share(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's buckets -> (g, key, n) for every n-gram that sets of like size share, g being the least of them."""
    buckets: dict[int, list] = {}
    for x in parts:
        for row in x.itertuples(index=False):
            buckets.setdefault(row.bucket, []).append(row)
    for rows in buckets.values():
        token, key, n = _entries(rows)
        step = size_step(n)
        # A set sent by several tasks is one.
        order = np.lexsort((key, step, token))
        token, key, n, step = token[order], key[order], n[order], step[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, key, n, step = token[once], key[once], n[once], step[once]
        # A new run where the n-gram changes, or where a step of size is left out.
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (step[1:] > step[:-1] + 1)])
        size = np.diff(np.r_[start, len(token)])
        least, keep = np.repeat(np.minimum.reduceat(key, start), size), np.repeat(size > 1, size)
        yield pd.DataFrame({"g": least[keep], "key": key[keep], "n": n[keep]})


def _hot_least(count: int):
    """Packed frequent first n-grams -> the least key that has each, of this task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.full(count, np.iinfo(np.int64).max)
        for x in batches:
            for row in x.itertuples(index=False):
                place, key, _ = _entries([row])
                np.minimum.at(least, place, key)
        met = np.flatnonzero(least < np.iinfo(np.int64).max)
        yield pd.DataFrame({"place": met, "least": least[met]})

    return run


def _hot_share(names):
    """Packed frequent first n-grams -> as ``_share``; ``names`` has the least key of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for row in x.itertuples(index=False):
                place, key, n = _entries([row])
                yield pd.DataFrame({"g": names.value[place], "key": key, "n": n})

    return run


def cells(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(g, key): every pair of classes that may be linked is in one cell g."""
    spark = texts.sparkSession
    most = (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1 + F.floor(F.col("n") / 12)).cast("long")
    entries, count = named.where("sign is not null").agg(F.coalesce(F.sum(most), F.lit(0)), F.count("*")).first()
    often = named.where("n < 0").select("often").mapInPandas(_counts, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    often = often.where(F.col("times") >= max(LEAST, count // SHARE)).select("token").toArrow()["token"].to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(often.astype(np.uint64)))
    tasks = max(1, -(-int(entries) // ENTRIES))
    spread = staged(texts.select("text").mapInPandas(_spread(tasks, hot), _PACKED), "jaccard-firsts")
    found = spread.where("bucket >= 0").repartitionById(tasks, "bucket").mapInPandas(_share, _FOUND)
    if len(hot.value):
        least = spread.where("bucket < 0").mapInPandas(_hot_least(len(hot.value)), "place long, least long").groupBy("place").agg(F.min("least").alias("least")).toArrow()
        names = np.zeros(len(hot.value), np.int64)
        names[least["place"].to_numpy()] = least["least"].to_numpy()
        names = spark.sparkContext.broadcast(names)
        found = found.unionByName(spread.where("bucket < 0").mapInPandas(_hot_share(names), _FOUND))
    found = staged(found.groupBy("g", "key").agg(F.max("n").alias("n"), F.count("*").alias("times")), "jaccard-found")
    unstage(spread)
    release(spark)
    # The smaller of two linked sets has 0.75 n n-grams at least.
    shared = found.groupBy("key").agg(F.max("n").alias("n"), F.sum("times").alias("times"))
    few = staged(shared.where(F.col("times") < 1 + F.floor(F.ceil(F.col("n") * NUM / DEN) / 12)).select("key"), "jaccard-few")
    m = staged(found.join(maybe_broadcast(few), "key", "left_anti").select("g", "key"), "jaccard-met")
    unstage(found)
    return m


def _near(run: dict[str, np.ndarray]) -> pd.DataFrame:
    """A cell -> (g, key) of the smaller cells that signatures part it into."""
    _, once = np.unique(run["key"], return_index=True)
    key, n, sign = run["key"][once], run["n"][once], run["sign"][once]
    size = np.array([len(x) for x in sign])
    top = np.arange(len(key))
    for length in np.unique(size):
        ours = np.flatnonzero(size == length)
        theirs = np.flatnonzero(size >= length)
        words = np.stack([folded(sign[i], length) for i in theirs])
        for i in ours.tolist():
            differ = np.bitwise_count(words[np.searchsorted(theirs, i)] ^ words).sum(1, dtype=np.int64)
            fits = (7 * differ <= n[i] + n[theirs]) & (DEN * np.minimum(n[i], n[theirs]) >= NUM * np.maximum(n[i], n[theirs]))
            met = np.unique(top[theirs[fits]])
            if len(met) > 1:
                top[np.isin(top, met)] = met[0]
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, top, key)
    keep = np.bincount(top, minlength=len(key))[top] > 1
    return pd.DataFrame({"g": least[top][keep], "key": key[keep]})


def parted(m: DataFrame, signs: DataFrame, block: int) -> DataFrame:
    """Cells (g, key) of two to ``block`` rows, parted by the ``signs`` (key, n, sign); cells inside others are left out. Larger cells stay."""
    sized = staged(lookup(m, staged(m.groupBy("g").agg(F.count("*").alias("m")), "jaccard-sizes"), "g").where("m > 1"), "jaccard-sized")
    of_key = sized.where(F.col("m") <= block).groupBy("key").agg(F.collect_list("g").alias("of"))
    cut = signs.join(maybe_broadcast(staged(of_key, "jaccard-of")), "key").select(F.explode("of").alias("g"), "key", "n", "sign")
    near = cut.repartition("g").sortWithinPartitions("g").mapInPandas(by_run(("g",), _near), "g long, key long")
    m = staged(near.unionByName(sized.where(F.col("m") > block).select("g", "key")).distinct(), "jaccard-near")
    size = m.groupBy("g").agg(F.count("*").alias("m"))
    both = m.join(m.select("key", F.col("g").alias("other")), "key").where("other < g").groupBy("g", "other").agg(F.count("*").alias("m"))
    inside = staged(both.join(size, ["g", "m"]).select("g").distinct(), "jaccard-inside")
    return staged(m.join(maybe_broadcast(inside), "g", "left_anti"), "jaccard-members")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def product(left: list[np.ndarray], right: list[np.ndarray] | None, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose overlap reaches the bound. ``right`` None: the block with itself, i < j.

    Overlaps are added up n-gram by n-gram; n-grams held by the same documents are added at once.
    """
    both = left + (right or [])
    rows = np.repeat(np.arange(len(both)), [len(t) for t in both])
    token = np.concatenate(both)
    order = np.lexsort((rows, token))
    token, rows = token[order], rows[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[start, len(token)])
    # The documents of an n-gram, known by the sum of a random number of each.
    name = np.random.default_rng(1).integers(0, 1 << 63, len(both), np.uint64)
    sums = np.add.reduceat(name[rows], start)
    live = np.flatnonzero(size > 1)
    _, one, times = np.unique(sums[live], return_index=True, return_counts=True)
    m, k = len(left), len(left) if right is None else len(right)
    overlap = np.zeros((m, k), np.int32)
    for at, c in zip(live[one], times, strict=True):
        held = rows[start[at] : start[at] + size[at]]
        i = held if right is None else held[: np.searchsorted(held, m)]
        j = held if right is None else held[len(i) :] - m
        if len(i) and len(j):
            overlap[i[:, None], j] += c
    linked = overlap * (NUM + DEN) >= NUM * (n_left[:, None] + n_right[None, :])
    if right is None:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def _links(run: dict[str, np.ndarray]) -> pd.DataFrame:
    """One block with itself (side 0 only) or two blocks (sides 0 and 1): spanning links (a, b) of linked classes."""
    sides = []
    for s in (0, 1):
        at = np.flatnonzero(run["side"] == s)
        sides.append(at[np.unique(run["key"][at], return_index=True)[1]])
    left, right = ([unpacked([run["tokens"][i]]) for i in x] for x in sides)
    keys, n = np.concatenate([run["key"][x] for x in sides]), [run["n"][x] for x in sides]
    out = []
    if left and (right or len(left) > 1):
        i, j = product(left, right or None, n[0], n[1] if right else n[0])
        j = j + (len(left) if right else 0)
        forest = _Forest(len(keys))
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.top(x) != forest.top(y):
                forest.join(x, y)
                out.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
    out = np.array([p for p in out if p[0] != p[1]], np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _meet(blocks: DataFrame) -> DataFrame:
    """(block columns g, i, j, side, key, n, tokens) -> links."""
    return blocks.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(by_run(("g", "i", "j"), _links), "a long, b long")


def exact_links(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links among ``members`` (g, m, key, n, tokens), where only rows of one cell g, of ``m`` rows, may be linked.

    Every linked pair of different classes ends in one component of the links returned.
    """
    cell = lambda df, i, j, side: df.select("g", F.expr(i).alias("i"), F.expr(j).alias("j"), F.lit(side).alias("side"), "key", "n", "tokens")
    small = members.where(F.col("m") <= block)
    large = members.where(F.col("m") > block).withColumn("of", F.ceil(F.col("m") * 1.25 / block).cast("int"))
    # Blocks are dealt by a hash of the class: about 0.8 of ``block`` rows each.
    large = staged(large.withColumn("b", F.pmod(F.xxhash64("key"), F.col("of")).cast("int")).select("g", "b", "of", "key", "n", "tokens"), "jaccard-large")
    first = large.where("b = 0").withColumn("to", F.explode(F.sequence(F.lit(1), F.col("of") - 1)))
    links = staged(_meet(cell(small, "0", "0", 0).unionByName(cell(large, "b", "b", 0)).unionByName(cell(first, "to", "0", 0)).unionByName(cell(large.where("b > 0"), "b", "0", 1))), "jaccard-links")
    if not large.limit(1).count():
        unstage(large)
        return links
    # Second turn: documents outside their cell's largest class meet every block where sizes allow a link.
    class_of = connected_components(links, "jaccard-first")
    at = lookup(large.select("g", "b", "of", "key", "n"), class_of.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    at = staged(at, "jaccard-at")
    biggest = at.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("big"))
    at = lookup(at, staged(biggest, "jaccard-biggest"), "g")
    # Sorted into steps of size, so that a row only meets the steps next to its own.
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    at = at.select("g", "b", "of", "key", step.alias("s"), (F.col("label") != F.col("big")).alias("outside"))
    outside = at.where("outside")
    chunks = staged(outside.groupBy("g", F.col("s").alias("os")).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")), "jaccard-chunks")
    if not chunks.limit(1).count():
        unstage(large)
        return links
    # A row of any class (side 1) goes to each chunk of outside rows (side 0) of the steps next to its own.
    chunk = F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")).cast("int").alias("chunk")
    left = outside.withColumn("os", F.col("s")).join(maybe_broadcast(chunks), ["g", "os"]).select("g", "os", "of", "key", chunk)
    left = left.select("g", "os", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("b"), F.lit(0).alias("side"))
    right = at.withColumn("os", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))).join(maybe_broadcast(chunks), ["g", "os"])
    right = right.select("g", "os", "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "b", F.lit(1).alias("side"))
    meet = left.unionByName(right).select("g", F.concat_ws("/", F.lit("second"), "os", "chunk").alias("i"), F.col("b").cast("string").alias("j"), "side", "key")
    second = staged(_meet(meet.join(large.select("g", "key", "n", "tokens"), ["g", "key"])), "jaccard-second")
    unstage(large)
    return links.unionByName(second)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    named = staged(texts.mapInPandas(_named, _NAMED), "jaccard-named")
    met = cells(texts, named)
    signed = named.where("sign is not null")
    ours = staged(met.select("key").distinct(), "jaccard-keys")
    m = parted(met, signed.select("key", "n", "sign").join(maybe_broadcast(ours), "key", "left_semi"), PART)
    sized = lookup(m, staged(m.groupBy("g").agg(F.count("*").alias("m")), "jaccard-sizes"), "g")
    of_key = staged(sized.groupBy("key").agg(F.collect_list(F.struct("g", "m")).alias("cells")), "jaccard-cells")
    # Each class of a cell is read again from one of its rows.
    one = signed.select("key", "doc_id", "th").join(maybe_broadcast(of_key.select("key")), "key", "left_semi").groupBy("key")
    one = staged(one.agg(F.min(F.struct("doc_id", "th")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th")), "jaccard-rows").distinct()
    # Texts are wide: those of rows that no class is read from are not shuffled.
    again = sieved(texts.withColumn("_row", F.xxhash64("doc_id", "th")), one.withColumn("_row", F.xxhash64("_id", "_th")), "_row")
    again = again.where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text")
    members = again.mapInPandas(_tokens, "key long, n long, tokens binary").join(maybe_broadcast(of_key), "key")
    links = exact_links(members.select(F.explode("cells").alias("c"), "key", "n", "tokens").select("c.g", "c.m", "key", "n", "tokens"))
    rows = named.where("n >= 0").select("doc_id", "n", "key")
    unstage(met, ours, m, of_key)
    release(spark)
    component = connected_components(links, "jaccard")
    least = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    # The classes that have links; the others are their own component.
    linked = staged(least.join(maybe_broadcast(component), least.key == component.node).select("key", "least", "label"), "jaccard-linked")
    named = lookup(linked, staged(linked.groupBy("label").agg(F.min("least").alias("component")), "jaccard-named"), "label").select("key", "component")
    named = named.unionByName(least.join(maybe_broadcast(linked.select("key")), "key", "left_anti").select("key", F.col("least").alias("component")))
    out = lookup(rows, staged(named, "jaccard-component"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: the one of the smallest doc_id (null after all others).

    Rows are told apart by id and text, so rows that repeat an id with other texts stay or go by their texts.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = join(docs.select(row.alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component")).distinct()
    named = docs.select(row.alias("_row"), "doc_id").distinct().join(found, "_row")
    named = staged(named, "jaccard-named")
    kept = named.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
    # Narrow: the rows that go.
    gone = staged(named.join(kept, "_component").where("least._row <> _row").select("_row"), "jaccard-gone")
    left = sieved(docs.select(F.struct("*").alias("_d"), row.alias("_row")), gone, "_row", "left_anti")
    twice = staged(left.groupBy("_row").count().where("count > 1").select("_row"), "jaccard-twice")
    if twice.limit(1).count():
        again = left.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
        left = left.join(twice, "_row", "left_anti").unionByName(again)
    return left.select("_d.*")
