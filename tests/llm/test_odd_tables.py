"""Nulls in any column, repeated rows, clashing names and empty tables, for every operator on documents and pages."""

import collections

import pytest

from tidewater.llm import ann_tree, decontamination, html_consensus, jaccard_join, license_scan, mixing, quality, token_counts, toxicity, warc

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
#: (doc_id, text, source): null ids and texts, a repeated row, one id with two texts, a long text.
ROWS = [
    (None, None, None), (None, TEXT, "a"), (1, TEXT, None), (1, TEXT, None), (2, None, "a"), (3, "", "a"), (4, "alpha beta", "b"), (4, "gamma delta", "b"), (5, "x " * 30_000, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, source string, lang string, score double, size long, copies long, copy int, n long, key long, h string, w string, label int, toxic int, quality int, component_id long, path string, html string"
    return spark.createDataFrame([(*r, *[None] * 15) for r in ROWS], schema).repartition(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, TEXT), (7, TEXT), (None, TEXT), (8, None)], "item_id long, text string")


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


WANT = collections.Counter(r[0] for r in ROWS)


def test_one_row_a_document(spark, odd, labels):
    for found in (
        mixing.plan(odd), toxicity.score(odd, labels), quality.score(odd, labels), license_scan.licenses(odd), jaccard_join.join(odd), token_counts.counts(odd),
    ):
        assert ids(found) == WANT


def test_values_of_odd_rows(odd):
    sets = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd).collect()}
    assert sets == {(None, 0, None), (None, 12, 1), (1, 12, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5)}
    sizes = {(r.doc_id, r.size) for r in mixing.plan(odd).collect()}
    assert sizes == {(None, 0), (None, 16), (1, 16), (2, 0), (3, 0), (4, 2), (5, 30_000)}


def test_stages_keep_columns_and_clean_rows(odd, labels, bench):
    for kept in (toxicity.keep_clean(odd, labels), quality.keep_good(odd, labels), jaccard_join.keep_one(odd), decontamination.keep_clean(odd, bench)):
        assert kept.columns == odd.columns
        assert not ids(kept) - WANT
    left = ids(decontamination.keep_clean(odd, bench))
    assert left == {None: 1, 2: 1, 3: 1, 4: 2, 5: 1}
    mixed = ids(mixing.mix(odd))
    assert all(n <= 2 * WANT[i] for i, n in mixed.items())


def test_overlaps_of_repeated_and_null_items(odd, bench):
    found = collections.Counter((r.doc_id, r.item_id) for r in decontamination.overlaps(odd, bench).collect())
    assert found == {(None, 7): 1, (None, None): 1, (1, 7): 1, (1, None): 1}


def test_empty_tables(odd, labels, bench):
    none = odd.limit(0)
    for found in (
        mixing.plan(none), mixing.mix(none), toxicity.score(none, labels), quality.score(none, labels), license_scan.licenses(none), jaccard_join.join(none),
        token_counts.counts(none), decontamination.overlaps(none, bench), decontamination.keep_clean(none, bench), toxicity.keep_clean(none, labels), quality.keep_good(none, labels),
    ):
        assert found.count() == 0


def test_odd_pages(spark):
    page = "<html><body><article><p>Text of it</p></article></body></html>"
    rows = [(None, None, None, "x"), (1, "http://h.test/", page, None), (1, "http://h.test/", page, None), (2, "no url", page, None), (3, "http://h.test/", "<p>" * 20_000 + "deep", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = collections.Counter((r.page_id, r.text) for r in html_consensus.main_text(pages).collect())
    assert got == {(None, ""): 1, (1, "Text of it"): 2, (2, "Text of it"): 1, (3, "deep"): 1}
    made = warc.derivatives(warc.responses(pages), "page_id").collect()
    assert len(made) == 2 * len(rows) and warc.derivatives(warc.responses(pages.limit(0)), "page_id").count() == 0


def test_repeated_vector_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 2.0]), (5, [2.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = collections.defaultdict(list)
    for r in ann_tree.search(spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, rank string")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    brute = collections.defaultdict(list)
    for k, (q, x) in enumerate(rows):
        if q is not None and q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(rows) if m != k and i is not None)
            brute[q] += [(i, -s) for s, i in near]
    assert {q: sorted(f) for q, f in got.items()} == {q: sorted(f) for q, f in brute.items()}


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 2}", 1, 2, 3, 4, 5) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _own int, copy int, _row int, _d int")
    mixed = mixing.mix(d)
    assert mixed.columns == [*d.columns, "copy_"] and {(r["_id"], r["_own"], r["copy"], r["_d"]) for r in mixed.collect()} == {(1, 2, 3, 5)}
    assert jaccard_join.keep_one(d).columns == d.columns
