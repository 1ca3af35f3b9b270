"""The whole job, where operators once did less: every overlap, whole articles and pages, every row."""

import collections
import itertools
import random

import numpy as np

from tidewater.llm import decontamination, html_consensus, jaccard_join, license_scan, mixing, queries, warc


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def brute_overlap(doc, item):
    """Whether 12 of 16 item words, or as large a part of a shorter item, agree on some diagonal; without masks."""
    span = min(16, len(item))
    for dg in range(1 - len(item), len(doc)):
        ok = [0 <= dg + i < len(doc) and doc[dg + i] == x for i, x in enumerate(item)]
        if any(4 * sum(ok[i : i + span]) >= 3 * span for i in range(len(item) - span + 1)):
            return True
    return False


def test_masks_hit_every_pattern():
    for length, wrong in ((15, 3), (16, 4)):
        for bad in itertools.combinations(range(length), wrong):
            assert any(not {p + m for m in mask} & set(bad) for mask in decontamination.MASKS for p in range(length - mask[-1])), bad


def test_decontamination_against_brute_force(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (15, 16, 24, 37, 59)}
    rng, texts = np.random.default_rng(6), []
    for item in items.values():
        texts += [[w if k % 4 != at else f"x{k}" for k, w in enumerate(item)] for at in range(4)]
        for share in (0.2, 0.25, 0.3, 0.4):
            texts += [["y"] * 3 + [w if rng.random() > share else "x" for w in item] + ["y"] * 2 for _ in range(15)]
    # A lone stretch of 16 words with each placement of 4 replaced ones, and of 5.
    for wrong, step in ((4, 1), (5, 40)):
        texts += [["x" if k in bad else w for k, w in enumerate(items[16])] for bad in list(itertools.combinations(range(16), wrong))[::step]]
    want = {(i, n) for i, t in enumerate(texts) for n, item in items.items() if set(t) & set(item) and brute_overlap(t, item)}
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    d = docs(spark, [" ".join(t) for t in texts])
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(d, bench).collect()} == want
    assert {r.doc_id for r in decontamination.keep_clean(d, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_short_items_against_brute_force(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 15)}
    texts = []
    for n, item in items.items():
        for wrong in range(n // 4 + 2):
            for bad in list(itertools.combinations(range(n), wrong))[:: 1 if wrong <= n // 4 else 50]:
                texts.append(["x" if k in bad else w for k, w in enumerate(item)])
        texts.append(["y", "y", *item, "y"])
    want = {(i, n) for i, t in enumerate(texts) for n, item in items.items() if set(t) & set(item) and brute_overlap(t, item)}
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = decontamination.overlaps(docs(spark, [" ".join(t) for t in texts]), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {n for _, n in want} == set(items)


def test_windows_are_laid_out_once_for_all_masks(spark):
    rows = [(1, [5, 7, 5, 9, 7, 5, 8, 6, 5, 7, 5, 9, 7, 5, 8, 6]), (2, [5, 7]), (3, [])]
    words = spark.createDataFrame(rows, "doc_id long, h array<bigint>")
    got = decontamination.windows(words, ["doc_id"], "h", [0, 1, 4])
    # No lambda is evaluated for each window, which took most of the time.
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    masks = [mask for c in (0, 1, 4) for mask in decontamination.CLASSES[c][1]]
    want = [(d, p, (mask, *[h[p + m] for m in mask])) for d, h in rows for mask in masks for p in range(len(h) - mask[-1])]
    seeds = collections.defaultdict(list)
    for r in got.collect():
        seeds[r.seed].append((r.doc_id, r.p))
    alike = collections.defaultdict(list)
    for d, p, key in want:
        alike[key].append((d, p))
    assert sorted(map(sorted, seeds.values())) == sorted(map(sorted, alike.values()))


LONG = "word " * 60


def test_html_keeps_the_article_around_its_longest_part():
    page = f"<body><div>Top</div><article><h1>T</h1><p>intro</p><div class=body>{LONG}</div><p>end</p></article></body>"
    assert html_consensus.extract(page, None) == f"T\nintro\n{LONG.strip()}\nend"
    assert html_consensus.extract(page, "") == html_consensus.extract(page, max((share, path) for path, (share, _) in html_consensus.votes(page).items())[1])
    sections = f"<body><div class=c><h1>T</h1><section class=a>{LONG}</section><section class=b>{LONG}b</section><section class=d>z</section></div></body>"
    assert html_consensus.extract(sections, None) == f"T\n{LONG.strip()}\n{LONG}b\nz"
    table = f"<body><article><p>para</p><table><tr><td>{LONG}<td>cell</table></article></body>"
    assert html_consensus.extract(table, None) == f"para\n{LONG.strip()}\ncell"
    apart = f"<body><main><article class=a>{LONG}</article><article class=b>{LONG}b</article></main></body>"
    assert html_consensus.extract(apart, None) == f"{LONG.strip()}\n{LONG}b"
    # A host path that holds little of a page does not cut it.
    seen = html_consensus.walk(apart + "<div>x</div>").paths
    path = next(seen.digest(k) for k in range(len(seen.up)) if seen.shown(k).endswith(">div"))
    assert html_consensus.extract(apart + "<div>x</div>", path) == f"{LONG.strip()}\n{LONG}b"


def test_html_skips_whole_names_and_never_the_article():
    text = LONG.strip()
    for name in ("layout has-sidebar", "content no-sidebar", "post comments-open", "sidebar", "comments"):
        assert html_consensus.extract(f"<body><div class='{name}'><article><p>{LONG}</p></article></div></body>", None) == text
    assert html_consensus.extract(f"<body><form><div class=menu>m</div><p>{LONG}</p></form></body>", None) == text
    inline = f"<article><p>{LONG}</p><code>a <span class='comment'>#x</span></code><p class=alert>b <math>y</math></p><div class='tags byline'>c</div></article>"
    assert html_consensus.extract(inline, None) == f"{text} a #x\nb y\nc".replace(f"{text} a", f"{text}\na")
    rest = f"<nav>n</nav><article><p>{LONG}</p><div class=comments><article>c</article></div></article><div class='x ad'>buy</div><div class=related><article>r</article></div>"
    assert html_consensus.extract(rest, None) == text


def test_warc_conversion_holds_the_whole_page():
    def text(page):
        return warc.derive("r", "u", None, page.encode())[1].block.decode()

    page = "<head><title>No</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav><div class=ad>Buy</div><div class='x has-sidebar'><p>Text</p><script>var t;</script></div><noscript>Plain</noscript><aside>Side</aside><form>Say <textarea>so</textarea></form><footer>Foot</footer></body>"
    assert text(page) == "Menu\nBuy\nText\nPlain\nSide\nSay so\nFoot"
    assert text("<div class='layout has-sidebar'><article>Only</article></div>") == "Only"


def test_warc_query_returns_the_records(spark):
    rows = queries.op4_warc_derivatives(spark, "/root/testdata/sf0.001").limit(20).collect()
    for r in rows:
        (record,) = warc.parse(r.warc.encode())
        assert record.block.decode() == r.payload and record.fields["WARC-Record-ID"] == r.record_id
        assert record.fields["WARC-Date"] == warc.DATE and record.fields["Content-Type"]
    assert rows


def test_license_places_before_a_better_one():
    text = "under the mit licence, under the mit license, undr the mit licens; cc byy nc cc by nc"
    assert license_scan.scan(text)[1] == [(0, 3, "mit", 1), (4, 7, "mit", 0), (8, 11, "mit", 2), (12, 14, "cc-by-nc", 1), (15, 17, "cc-by-nc", 0)]


def test_keep_one_by_row(spark):
    one, two, three = "a b c d e f", "other words that are here now", "some more words for a third"
    rows = [(1, one), (2, one), (2, two), (3, two), (2, three), (2, three), (None, one), (None, "x y z"), (None, "x y z"), (None, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (2, two), (2, three), (None, "x y z"), (None, None)], key=str)


def test_html_skips_names_joined_of_furniture():
    text = LONG.strip()
    page = (
        "<body><div class='cookie-notice'><p>We use cookies</p></div><div id=site_header>Top</div><div class='content'><div class=section-header><h2>H</h2></div>"
        f"<p>{LONG}</p><div class='ad-slot2'>buy</div><p class=comment-free>e</p></div><section class='user-comments'><p>c</p></section><div role=contentinfo>f</div></body>"
    )
    assert html_consensus.extract(page, None) == f"H\n{text}\ne"
    # Around the article, or most of a page's text, no name counts; a stray word beside it is not of it.
    for name in ("main-sidebar", "comment-list"):
        assert html_consensus.extract(f"<body><div class='{name}'><p>{LONG}</p></div><p>x</p></body>", None) == text


def test_leaks_go_by_row(spark):
    """Another text of a contaminated row's id stays, with an id and without one."""
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item, "a"), (1, "other words here", "b"), (None, f"x {item} y", "c"), (None, "clean", "d"), (None, None, "e"), (2, item, "f"), (2, None, "g"), (2, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = decontamination.keep_clean(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted(r.key for r in kept.collect()) == ["b", "d", "e", "g", "h"]


def test_mix_deals_copies_of_equal_rows(spark):
    """Rows that agree in id, source and size are taken as often together as the plan says."""
    rows = [(i // 3, f"w{i} x y" if i % 2 else "a b c", "s" if i < 30 else None) for i in range(60)] + [(None, "p q", "t")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = collections.Counter(), collections.Counter()
    for r in mixing.plan(docs).collect():
        want[r.doc_id, r.source] += r.copies
    out = mixing.mix(docs).collect()
    for r in out:
        got[r.doc_id, r.source] += 1
    assert got == +want
    assert sorted(out, key=str) == sorted(mixing.mix(docs).collect(), key=str)


def distance(a, b, change):
    """Edits between two strings; ``change`` is the cost of another letter."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (0 if x == y else change)))
    return row[-1]


def test_license_labels_against_edit_distance():
    """Labels are those of the phrases that some run of words comes near enough to."""
    rng = random.Random(5)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += rng.choices(["alpha", "under", "the", "2", "by", "licence"], k=rng.randint(0, 4))
            chars = list(rng.choice(license_scan.PHRASES)[0])
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(chars)), rng.randrange(3)
                chars[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice("abt ")]
            words += "".join(chars).split()
        want = set()
        for phrase, label, edits, limit in license_scan.PHRASES:
            for a in range(len(words)):
                for b in range(a + 1, len(words) + 1):
                    span = " ".join(words[a:b])
                    if abs(len(span) - len(phrase)) <= edits and distance(span, phrase, 9 if "s<=0" in limit else 1) <= edits:
                        want.add(label)
        assert {f[2] for f in license_scan.scan(" ".join(words))[1]} == want, words
