"""Centroids, hard negatives and packing: plain computations, odd rows, ties and empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import centroids, hard_negatives, packing

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, q string, uid string, cluster int, ids int, block int, score int, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *[None] * 7) for i, v, label in rows], VECTORS).repartition(3)


def odd_rows(dim, seed=1, huge=False):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], i % 4) for i in range(240)]
    rows += [(i, [0.25] * dim, 1) for i in range(300, 420)]  # one vector of many rows
    rows += [(7, rows[7][1], 3), (7, rows[7][1], 3), (50, rows[3][1], 2), (100, [0.25] * dim, 1)]  # repeated ids and rows
    rows += [(None, [0.5] * dim, 1), (900, None, 1), (901, [None] + [0.5] * (dim - 1), 1), (902, [NAN] * dim, 1), (903, [INF] * dim, 1), (904, [0.5] * dim, None)]
    rows += [(950, [0.0] * dim, 0), (951, [], 1), (952, [0.5] * (dim - 1), 2)]
    return rows + ([(960, [3e9] * dim, 1), (1000, [-2e7] * dim, 1)] if huge else [])


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


def plain_clusters(rows, dim, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if finite(v) and len(v) == dim]
    turn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in turn[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, p)), j) for j, p in enumerate(c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, q in kept:
            own[near(q)[1]].append(q)
        c = [[sum(x) // len(x) for x in zip(*own[j])] if own[j] else p for j, p in enumerate(c)]
    out = [(i, *near(q)) for i, q in kept]
    by = collections.Counter()
    for _, d, j in out:
        by[j] += d
    name = lambda p: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()
    return collections.Counter((i, j, d, by[j], sum(by.values()), name(c[j])) for i, d, j in out)


@pytest.mark.parametrize(("k", "huge"), [(6, False), (400, False), (5, True)])
def test_clusters_equal_plain_lloyd(spark, k, huge):
    # 3e9 * 256 squared is beyond a long; smaller ones are exact beyond what doubles hold.
    rows = [r for r in odd_rows(6, huge=huge) if r[0] != 960]
    got = centroids.clusters(vectors(spark, rows), k=k, rounds=3, dim=6)
    got = collections.Counter(tuple(r)[:6] for r in got.collect())
    assert got == plain_clusters(rows, 6, k, 3)


def test_clusters_of_odd_tables(spark):
    assert centroids.clusters(vectors(spark, odd_rows(4)).limit(0)).count() == 0
    assert centroids.clusters(vectors(spark, odd_rows(4)), dim=64).count() == 0
    few = centroids.clusters(vectors(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [5.0, 2.0], None)]), dim=2).collect()
    assert sorted((r.vec_id, r.distance, r.multiplicity) for r in few) == [(1, 0, 2), (1, 0, 2), (2, 0, 1)]
    # Beyond a long: held at its end, not lost.
    far = centroids.clusters(vectors(spark, [(1, [1e18, 0.0], 0), (2, [-1e18, 0.0], 0)]), k=1, dim=2).collect()
    assert [r.distance for r in far] == [centroids.LONG] * 2


def plain_negatives(rows, every=50):
    dim = max((len(v) for _, v, _ in rows if finite(v)), default=0)
    kept = [(i, whole(v) + [0] * (dim - len(v)), c) for i, v, c in rows if i is not None and c is not None and finite(v)]
    out = collections.Counter()
    for n, (i, q, c) in enumerate(kept):
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, p)), j, d) for m, (j, p, d) in enumerate(kept) if m != n)
        for ps, j, _ in [x for x in s if x[2] == c][:5]:
            hard = [x for x in s if x[2] != c and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            for rank, (ns, h, _) in enumerate(hard, 1):
                out[i, j, rank, h, -ps, -ns] += 1
    return out


@pytest.mark.parametrize(("block", "huge"), [(4096, False), (3, False), (3, True)])
def test_hard_negatives_equal_brute_force(spark, block, huge):
    rows = [r for r in odd_rows(5, 2, huge) if r[0] != 960]
    got = collections.Counter(map(tuple, hard_negatives.mine(vectors(spark, rows), block=block).collect()))
    assert got == plain_negatives(rows) and got


def test_hard_negatives_of_cells_and_chunks(spark, monkeypatch):
    for name, n in (("CELL", 20), ("CHUNK", 2), ("FIRST", 1), ("WIDEN", 2), ("PIVOTS", 3)):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = odd_rows(4, 5)
    got = collections.Counter(map(tuple, hard_negatives.mine(vectors(spark, rows), every=10, block=8).collect()))
    assert got == plain_negatives(rows, 10)


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(vectors(spark, odd_rows(4)).limit(0)).count() == 0
    assert hard_negatives.mine(vectors(spark, [(50, [1.0], 1)])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(7, [1.0], 1), (8, [1.0], 2)])).count() == 0
    moved = hard_negatives.shifted(vectors(spark, [(7, [1.0], 9), (8, [1.0], 9), (14, None, None)])).collect()
    assert sorted((r.vec_id, r.label) for r in moved) == [(7, 0), (8, 9), (14, None)]


def test_key_bounds_hold():
    """No vector of a block is nearer than the block's bound."""
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (400, 8))
    longest = float((x * x).sum(1).max())
    m, pivots = hard_negatives.longer(x, longest), hard_negatives.longer(x[:5], longest)
    d = np.sqrt(((m[:, None] - pivots) ** 2).sum(2))
    at, far = d.argmin(1), d.min(1)
    part = at * 4 + np.minimum((far / (far.max() + 1) * 4).astype(int), 3)
    names = np.unique(part)
    keys = hard_negatives.Keys(pivots, longest, names, names * 0, names // 4, *(np.array([f(far[part == p]) for p in names]) for f in (min, max)))
    for q in x[::7]:
        number, bound = keys.order(q.astype(float), None, 0.0)
        real = np.sqrt(((m - np.append(q, 0.0)) ** 2).sum(1))
        assert all(real[part == p].min() >= b - 1e-6 for p, b in zip(number, bound)) and (np.diff(bound) >= 0).all()
        s = float(x[9] @ q)
        assert abs(keys.distance(float(q @ q), s) - real[9]) < 1e-6


DOCS = [
    (None, None), (None, "no id"), (1, "same text " * 40), (1, "same text " * 40), (2, ""), (3, "word " * 9000), (2**60 + 1, "a <|endoftext|> b  <|endoftext|>"),
    (5, "two  blanks\n\n and\t tabs 's it's  "), (6, "æøå 中文 　 wide blank  x 🙂🙂 " * 50), (7, "x" * 5000), (8, " lead"), (9, "\u0085 \u001c a ​ b"),
]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in DOCS], "doc_id long, text string, n int, g int, ids int").repartition(3)
    return packing.pack(docs).withColumn("crc", F.crc32("ids")).collect()


def test_pieces_are_the_tokens(packed):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    want = collections.Counter()
    for i, text in DOCS:
        want[i, np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    by = collections.defaultdict(list)
    for r in packed:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.crc
        by[r.doc_id, r.doc_tokens].append(r)
    for (i, b), times in want.items():
        rows = [r for r in by[i, len(b) // 4] if b[4 * r.start : 4 * (r.start + r.length)] == r.ids]
        covered = collections.Counter(k for r in rows for k in range(r.start, r.start + r.length))
        assert set(covered.values()) == {times} and len(covered) == len(b) // 4


def test_sequences_are_gapless_and_hardly_padded(packed):
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end and n > 0
            end += n
        assert 1024 - packing.PIECE < end <= 1024 or end & (end - 1) == 0 and end < 1024


@pytest.mark.parametrize("longest", [300, 1024])
def test_few_cuts_and_even_costs(longest):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, longest, 3000)
    pieces = packing.assign(lengths)
    price = lambda n: packing.LINEAR * n + packing.QUADRATIC * n * n
    cost, room, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for row, _, n, k, _ in pieces:
        cost[k] += price(n)
        room[k] += n
        seen[row] += n
    assert all(seen[i] == n for i, n in enumerate(lengths.tolist()))
    full = [cost[k] for k, n in room.items() if n > 1024 - packing.PIECE]
    assert len(room) - len(full) <= 10 and sum(1024 - room[k] for k in room if room[k] > 1000) < 0.005 * lengths.sum()
    assert len(pieces) < 1.3 * len(lengths)
    # The first sequence with room in the same order, for comparison, where documents are short enough to be spread.
    used, plain = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, u in enumerate(used) if u + n <= 1024), len(used))
        if k == len(used):
            used.append(0)
            plain.append(0.0)
        used[k] += n
        plain[k] += price(n)
    if longest == 300:
        assert np.std(full) < 0.5 * np.std(plain[:-1])


def test_placing_takes_the_lowest_cost_with_room():
    rng = random.Random(6)
    lengths = np.array([rng.randrange(1, 64) for _ in range(200)])
    held = packing.Sequences(int(lengths.sum()), 64)
    size, used, cost = list(held.size), [0] * len(held.size), [0.0] * len(held.size)
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [k for k in range(len(size)) if size[k] - used[k] >= n]
        got = held.place(n, n)
        assert (got is None) == (not fit)
        if got:
            assert cost[got[0]] == min(cost[k] for k in fit) and got[1] == used[got[0]]
            used[got[0]] += n
            cost[got[0]] += packing.LINEAR * n + packing.QUADRATIC * n * n


def test_packing_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    one = packing.pack(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(4, 0, 1, 1, 0)]


def test_words_are_cut_where_tokens_are():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(packing.vocabulary()), packing.tokenizer(packing.vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("ab1.'s \n\t  ​\u0085\x1ceé中_🙂́"), max_size=24))
    def same(text):
        assert ids([text]) == [np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]

    same()


def test_the_faster_encoder_gives_the_same_ids(spark):
    import base64

    import public_tokenizers

    from tokenizers import Tokenizer

    path = packing.vocabulary()
    t = Tokenizer.from_file(path)
    fast = packing.ascii_encoder(path, t)
    assert packing.PATTERN == public_tokenizers.PATTERN
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert fast.__self__._mergeable_ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert packing.ascii_encoder(public_tokenizers.path("word_bpe_49k.json"), None) is None
    rng = random.Random(1)
    for _ in range(4000):
        text = rng.choice("ab-= .*\n") * rng.randrange(0, 60) + "".join(rng.choice(" aeinorst'.,0123-=_\n\tABZxyz#()<>/\\|~`\x00\x1c\x7f") for _ in range(rng.randrange(1, 60)))
        assert fast(text) == t.encode(text, add_special_tokens=False).ids
    words = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        words.update(w for w in packing.words_of(r.text or "") if w.isascii() and packing.SPECIAL not in w)
    text = "".join(sorted(words))
    assert fast(text) == t.encode(text, add_special_tokens=False).ids


def test_latin_letters_go_to_the_faster_encoder(monkeypatch):
    from tokenizers import Tokenizer

    path, seen = packing.vocabulary(), []
    t, made = Tokenizer.from_file(path), packing.ascii_encoder

    def watched(*args):
        fast = made(*args)
        return lambda text: seen.append(text) or fast(text)

    monkeypatch.setattr(packing, "ascii_encoder", watched)
    monkeypatch.setattr(packing, "_ready", {})
    letters = [chr(c) for c in range(0x250) if packing._LATIN.fullmatch(chr(c))]
    assert len(letters) == 128 + 0x250 - 0xC0 - 2 and all(x.isalpha() for x in letters[128:])
    rng = random.Random(3)
    texts = ["Él 1 ñandú, größer 中文 x", "a  b \n c× d", *("".join(rng.choice(letters) if rng.random() < 0.6 else " 's" for _ in range(80)) for _ in range(500))]
    texts += ["".join(f" {a}{x}{b}" for x in letters for a in ("", "a", ".", "1") for b in ("", "b", "'s", "2"))]
    got = packing.tokenizer(path)(texts)
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert all(any(f" {w}" in s for s in seen) for w in ("ñandú,", "größer"))
    assert not any("中" in s or "×" in s for s in seen)


def test_words_are_cut_alike_at_blanks_and_by_looking_ahead():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=500, deadline=None)
    @given(st.text(st.sampled_from("ab1.' \n\té中_🙂́"), max_size=24))
    def same(text):
        first, words = packing.cut(text)
        assert [x for x in (first, *(f" {w}" for w in words)) if x] == [x for x in packing.words_of(text) if x]

    same()
    assert packing.cut(f" a {packing.SPECIAL} b") == (f" a {packing.SPECIAL} b", [])
