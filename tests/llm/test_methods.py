"""The trained models and exact bounds against plain computations."""

import numpy as np

from tidewater.llm import jaccard_join, quality, toxicity


def test_word_logits_are_means_over_the_words_own_grams():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.0)
    for text in ("One of  the wörds, x yz!", "a", "", "12 ab-cd " * 3):
        words = toxicity.spaced(text).split()
        got = model.words(text)
        assert len(got) == len(words)
        for w, z in zip(words, got, strict=True):
            bag, at, size = toxicity.bags_of([w])
            assert abs(z - model.logit[bag].mean()) < 1e-4 and len(bag) == size[0] and at[0] == 0


def test_joint_fit_lowers_the_loss_of_both_parts():
    rows = [(f"alpha beta{i} gamma", 0) for i in range(30)] + [(f"alpha badword{i % 3} gamma", 1) for i in range(10)]
    model = toxicity.fit(rows)
    score = model.score(t for t, _ in rows)
    assert score[30:].min() > 0.7 > 0.3 > score[:30].max()
    assert model.score(["alpha badwords gamma"])[0] > 0.5 > model.score(["alpha delta gamma"])[0]


def test_dual_descent_closes_the_gap():
    rng = np.random.default_rng(3)
    xs = [np.unique(rng.integers(0, 40, 8)) for _ in range(80)]
    y = np.where([(x < 10).sum() > 2 for x in xs], 1.0, -1.0)
    ratio = rng.normal(size=40)
    w, bias = quality.descend(xs, ratio, y, 0.5)
    margin = np.array([(w[x] * ratio[x]).sum() + bias for x in xs])
    primal = 0.5 * (w @ w + bias * bias) + 0.5 * np.maximum(0, 1 - y * margin).sum()
    # The turns are few, so a gap stays: no small step in any direction does better by one part in a hundred.
    for _ in range(200):
        d, b = rng.normal(size=40) * 0.01, rng.normal() * 0.01
        m = np.array([((w + d)[x] * ratio[x]).sum() + bias + b for x in xs])
        assert 0.99 * primal <= 0.5 * ((w + d) @ (w + d) + (bias + b) ** 2) + 0.5 * np.maximum(0, 1 - y * m).sum()


def test_quality_learns_from_words_shapes_and_repeats():
    good = [(f"the quiet river number{i} runs past old houses and fields", 1) for i in range(40)]
    for poor in ("BUY NOW!!! {i} CLICK HERE!!!", "same same same same same {i} same same", "lorem spamword ipsum {i} text spamword end"):
        model = quality.fit(good + [(poor.format(i=i), 0) for i in range(40)])
        assert model.score([poor.format(i=99)])[0] < 0.3 < model.score(["the quiet river number99 runs past old houses and fields"])[0]


def test_signatures_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)]))
        x, y = jaccard_join.signature(a), jaccard_join.signature(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_linked_sets_share_enough_first_grams():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 30))).astype(np.uint64)]))
        if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)) or not len(b):
            continue
        hot = np.sort(rng.choice(a, len(a) // 3, replace=False) >> np.uint64(16))
        row, token, _ = jaccard_join._firsts([a, b], hot)
        shared = len(np.intersect1d(token[row == 0], token[row == 1]))
        assert shared >= jaccard_join.least_shared(np.array(min(len(a), len(b))))
