"""The training-data operators against brute force, and their defined cases."""

import collections
import re

import numpy as np
import pytest

from tidewater.llm import ann_tree, common, decontamination, html_consensus, jaccard_join, license_scan, mixing, quality, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, score string, key long, label string"


def docs(spark, texts, source=None):
    rows = [(i, t, "en", (source or (lambda i: f"s{i % 3}"))(i), "x", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " \t\n", "one", "one", "b" * 50_000, "w " * 20_000]


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or ""))
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    return {i: (len(s), up[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_join(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(4)]
    texts = list(ODD) + ["A b c D e f", "a B c d e F", "a b c d e f g"]
    for b in base:
        for _ in range(6):
            w = b.split()
            for k in rng.integers(0, 60, rng.integers(0, 3)):
                w[k] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    common_part = " ".join(f"c{i}" for i in range(50))
    texts += [f"{common_part} " + " ".join(f"u{i}-{k}" for k in range(12)) for i in range(8)]
    whole = jaccard_join.exact_links
    monkeypatch.setattr(jaccard_join, "exact_links", lambda m: whole(m, block))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_keep_one_and_empty(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", None, "other words that are here now"])
    assert sorted(r.doc_id for r in jaccard_join.keep_one(d.union(d.where("doc_id = 0"))).collect()) == [0, 2, 3]
    assert jaccard_join.join(d.limit(0)).count() == 0
    assert jaccard_join.keep_one(d).columns == d.columns


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_mixing(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", *(" ".join(["w"] * n) for n in rng.integers(1, 60, 400))]
    d = docs(spark, texts, lambda i: None if i % 7 == 3 else "big" if i % 3 else f"s{i % 5}")
    rows = mixing.plan(d).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.plan(d.repartition(5)).collect()))
    by = collections.defaultdict(list)
    for r in rows:
        assert r.taken <= 2 * r.size and r.size == len((texts[r.doc_id] or "").split())
        by[r.source].append(r)
    names = sorted(k for k in by if k is not None) + [None]
    total = {k: sum(r.size for r in by[k]) for k in names}
    target, full = {}, set()
    while True:
        free = [k for k in names if k not in full]
        level = (1.5 * sum(total.values()) - sum(2 * total[k] for k in full)) / sum((5, 2, 1)[names.index(k) % 3] for k in free)
        over = {k for k in free if level * (5, 2, 1)[names.index(k) % 3] > 2 * total[k]}
        if not over:
            break
        full |= over
    for k in names:
        want = 2 * total[k] if k in full else level * (5, 2, 1)[names.index(k) % 3]
        assert all(abs(r.target - want) < 1e-6 for r in by[k])
        assert abs(sum(r.taken for r in by[k]) - want) <= 2 * max(r.size for r in by[k])
    mixed = collections.Counter(r.doc_id for r in mixing.mix(d).collect())
    assert mixed == {r.doc_id: r.copies for r in rows if r.copies}
    assert mixing.plan(d.limit(0)).count() == 0


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    item = [f"q{x}" for x in rng.integers(0, 10**6, 30)]
    other = [f"z{x}" for x in rng.integers(0, 10**6, 200)]
    changed = [w if i % 10 else "changed" for i, w in enumerate(item)]
    texts = ODD + [" ".join(other[:50] + item + other[50:]), " ".join(other[:9] + changed), " ".join(other), " ".join(item[:8] + other[:40])]
    bench = spark.createDataFrame([(7, " ".join(item).upper()), (8, "too short"), (9, None)], "item_id long, text string")
    d = docs(spark, texts)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.overlaps(d, bench).collect()) == [(7, 7), (8, 7)]
    assert sorted(r.doc_id for r in decontamination.keep_clean(d, bench).collect()) == [i for i in range(11) if i not in (7, 8)]
    assert decontamination.overlaps(d, bench.limit(0)).count() == 0
    plan = decontamination.overlaps(d, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def labelled(spark, n=240):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    texts, bad = [], []
    for i in range(n):
        w = [word() for _ in range(30)]
        if i % 3 == 0:
            w[int(rng.integers(0, 30))] = ("moronic", "wretch")[i % 2]
        texts.append(" ".join(w))
        bad.append(int(i % 3 == 0))
    return texts, bad


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, module):
    texts, bad = labelled(spark)
    if module is quality:
        texts = [t.upper() + "!!" if b else t for t, b in zip(texts, bad)]
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1 - b if module is quality else b, b) for i, b in enumerate(bad)] + [(500, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in module.score(d, labels).collect()}
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(len(texts)) if rows[i].held_out]
    want = [1 - bad[i] if module is quality else bad[i] for i in held]
    assert np.mean([rows[i].predicted == w for i, w in zip(held, want)]) > 0.9 and held
    flat = module.score(d, labels.limit(0)).collect()
    assert len({r.score for r in flat}) == 1


def test_misspellings_are_near():
    texts, bad = labelled(None)
    model = toxicity.fit(list(zip(texts, bad)))
    assert model.score(["abc moronics def"])[0] > model.score(["abc fedcba def"])[0]


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        q = p.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(q)] == q]
    return len(w), len(found), min((f[0] for f in found), default=None), max((f[0] for f in found), default=None), ",".join(sorted({f[1] for f in found}))


def test_licenses(spark):
    texts = ODD + ["Under the MIT-license, under the mit license.", "apache license version 2 cc BY nc", "undr the mit licence x", "cc by nd", "under the mit licensee", "cc byy nc"]
    rows = {r.doc_id: r for r in license_scan.licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
    assert [rows[i].labels for i in range(7, 13)] == ["mit", "apache-2,cc-by-nc", "mit", "", "mit", "cc-by-nc"]
    assert rows[9].fuzzy_spans == ["0-3:mit:2"] and 0 < rows[9].score < 1 == rows[7].score


def test_token_counts(spark):
    pieces = {"a": -1.0, "b": -1.5, "ab": -1.2, "abc": -1.3, "c": -3.0, token_counts.MARK: -0.5, token_counts.MARK + "a": -0.7}

    def brute(w):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(w)
        for d in range(1, len(w) + 1):
            n = len(w[d - 1].encode())
            options = [(best[d - 1][0] + token_counts.BYTE * n, best[d - 1][1] + n)]
            options += [(best[j][0] + pieces[w[j:d]], best[j][1] + 1) for j in range(d) if w[j:d] in pieces]
            best[d] = max(options, key=lambda x: (x[0], -x[1]))
        return best[-1][1]

    rng = np.random.default_rng(2)
    words = [token_counts.MARK + "".join(rng.choice(list("abcdé"), rng.integers(0, 9))) for _ in range(300)]
    assert token_counts.count_words(words, token_counts.backward(pieces)) == {w: brute(w) for w in words}
    rows = {r.doc_id: r for r in token_counts.counts(docs(spark, ODD)).collect()}
    assert (rows[0].n_tokens, rows[1].n_tokens, rows[6].n_pretokens) == (0, 0, 20_000) and rows[3].n_tokens == rows[4].n_tokens > 0


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype("float32")
    x[300:420] = x[7]
    rows = [(i, v.tolist(), 0, "e") for i, v in enumerate(x)]
    rows += [(600, None, 0, ""), (620, [0.0] * 8, 0, ""), (640, [float("nan")] * 8, 0, ""), (660, [1.0], 0, ""), (680, [1.0] * 7 + [None], 0, "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    got = collections.defaultdict(list)
    for r in ann_tree.search(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y, hit = x.astype(float), 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(600), -s))[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    assert ann_tree.search(d.limit(0)).count() == 0
    assert [r.vec_id for r in ann_tree.search(d.where("vec_id in (0, 5)")).collect()] == [5]


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div>
<div class="post-12"><h1>Head &amp; line</h1><p><b>One<br><p>Two  words &lt;b&gt;\n here</p><script>var t="</p>";</script><div class="comments"><p>Reader said</p></div></div>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(i, "http://h.test/%d" % i, PAGE, 1) for i in range(3)] + [(3, None, PAGE, 1), (4, "http://h.test/", None, 1), (5, "http://k.test/", "plain text", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_consensus.main_text(pages).collect()}
    want = "Head & line\nOne\nTwo words <b> here"
    assert [got[i].text for i in range(6)] == [want] * 4 + ["", "plain text"]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_consensus.main_text(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h.test/", PAGE), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    out = warc.derivatives(source, "page_id")
    rows = {(r.page_id, r.record_type): r for r in out.collect()}
    refers = {r.page_id: r.record_id for r in source.collect()}
    assert set(rows) == {(p, k) for p in (1, 2) for k in ("metadata", "conversion")}
    assert all(r.refers_to == refers[p] and r.content_length == len(r.payload.encode()) for (p, _), r in rows.items())
    assert "Two words <b> here" in rows[1, "conversion"].payload and rows[2, "conversion"].payload == ""
    assert rows[1, "metadata"].n_links == 1 and rows[1, "metadata"].source_digest == warc.digest(PAGE.encode())
    # Round trip: what is saved parses to the same records, and responses in a file give the same derivatives.
    warc.save(out, f"{tmp_path}/out")
    saved = [r for f in (tmp_path / "out").glob("*.gz") for r in warc.parse(f.read_bytes())]
    assert sorted((r.fields["WARC-Record-ID"], r.block.decode()) for r in saved) == sorted((r.record_id, r.payload) for r in rows.values())
    record = warc.Record({"WARC-Type": "response", "WARC-Record-ID": refers[1], "WARC-Target-URI": "http://h.test/", "WARC-Date": warc.DATE}, source.where("page_id = 1").first().block)
    (tmp_path / "in.warc").write_bytes(record.bytes() * 2)
    again = warc.derivatives(warc.read_responses(spark, f"{tmp_path}/in.warc")).collect()
    assert len(again) == 4 and {r.record_id for r in again} == {r.record_id for (p, _), r in rows.items() if p == 1}


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs_]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], d)
        assert out.columns == docs_.columns, name
        kept.append(common.staged(out, "test"))
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    ids = sorted(texts)
    comp = brute_components([texts[i] for i in ids])
    assert {r.doc_id for r in kept[3].collect()} == {i for k, i in enumerate(ids) if comp[k][1] == k}
    copies = collections.Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], d).collect())
    assert copies and max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in kept[-1].collect()}
