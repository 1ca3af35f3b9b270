"""What grows faster than the table: chance candidates, crowded cells, wide rows in shuffles."""

import random

import pytest

from tidewater.llm import common, jaccard_join


def members_met(monkeypatch):
    """Counts the rows whose n-grams go to the product."""
    met, product = [], jaccard_join.exact_links
    monkeypatch.setattr(jaccard_join, "exact_links", lambda members, *a: met.append(members.count()) or product(members, *a))
    return met


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_ngrams_of_short_words_make_no_candidates(spark, monkeypatch):
    # A third of the n-grams are of four words alone, as in a corpus so large that all such n-grams recur, but none is frequent.
    monkeypatch.setattr(jaccard_join, "SHARE", 1)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("a", "of", "the", "in")) if rng.random() < 0.8 else f"word{rng.random()}" for _ in range(200)) for _ in range(300)]
    made, cells = [], jaccard_join.cells

    def counted(*a):
        found = cells(*a)
        made.append(found.select("key").distinct().count())
        return found

    monkeypatch.setattr(jaccard_join, "cells", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs(spark, [*texts, texts[7] + " end"])).collect()}
    assert got == {i: i for i in range(300)} | {300: 7}
    assert made[0] <= 10


def test_a_passage_of_many_documents_does_not_reach_the_product(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHARE", 1)
    met, rng = members_met(monkeypatch), random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} " + " ".join(f"w{rng.random()}" for _ in range(60)) for _ in range(400)]
    others = [" ".join(f"w{rng.random()}" for _ in range(120)) for _ in range(30)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs(spark, [*texts, texts[9] + " end", *others])).collect()}
    assert got == {i: i for i in range(431)} | {400: 9}
    assert met[0] <= 4


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_sieved_is_a_join_by_bitmap(spark, monkeypatch, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    left = spark.range(60_000).selectExpr("if(id % 1000 = 0, null, id) k", "id v", "repeat('x', 50) wide")
    right = common.staged(spark.range(0, 100_000, 50).selectExpr("id k"), "test-right")
    got, want = common.sieved(left, right, "k", how), left.join(right, "k", how)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_pipeline_stage_by_shuffle_keeps_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[20:40] + [None, "", None]
    want = {i for i in range(60)} | {100, 101, 102}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "maybe_broadcast", lambda df, limit=3: common.maybe_broadcast(df, limit))
    kept = [r.doc_id for r in jaccard_join.keep_one(docs(spark, texts)).collect()]
    assert sorted(kept) == sorted(want)
