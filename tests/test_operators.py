"""Edge cases of rules, trees, ranges and encodings."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import encode
from tidewater.operators import exclusions, reports, routing, snapshots, trees
from tidewater.sources import sqltext


@pytest.mark.parametrize(
    "rule",
    [
        {"column": "c", "value_base64": "eA=="},
        {"table": "t", "table_name_without_prefix": "t", "column": "c", "value_base64": "eA=="},
        {"table": "t", "column": "c", "value_base64": "x!"},
        {"table": "t", "column": "", "value_base64": "eA=="},
    ],
)
def test_bad_rules_are_refused(rule):
    with pytest.raises(ValueError):
        exclusions.checked(rule)


def test_default_rule_and_nulls(spark):
    rows = spark.createDataFrame([("_edit_lock",), (None,), ("x",)], "meta_key string")
    kept = exclusions.apply_rules(rows, "wp_postmeta", []).collect()
    assert sorted(str(r.meta_key) for r in kept) == ["None", "x"]
    assert exclusions.apply_rules(rows, "wp_posts", []).count() == 3


def test_link_chains_and_cycles(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "x")] + [(f"b{i}", f"b{i + 1}") for i in range(50)]
    got = {r.path: (r.end, r.links) for r in trees.link_ends(spark.createDataFrame(links, "path string, target string")).collect()}
    assert got["a0"] == ("a30", 30) and got["a29"] == ("a30", 1)
    assert got["x"] == got["y"] == got["z"] == (None, None)
    assert got["b0"] == ("b50", 50) and got["b20"] == ("b50", 30)
    assert len(got) == len(links)


def test_directories_of_an_index(spark):
    files = spark.createDataFrame([("/a/b/c.txt",), ("/d",)], "path string")
    assert {(r.path, r.type) for r in trees.with_directories(files).collect()} == {("/", "dir"), ("/a", "dir"), ("/a/b", "dir"), ("/a/b/c.txt", "file"), ("/d", "file")}


def test_range_borders(spark):
    points = spark.createDataFrame([(0,), (5,), (9,), (10,), (None,)], "at int")
    ranges = spark.createDataFrame([(5, 10, "r"), (10, 10, "none")], "start int, stop int, name string")
    got = {r.at: r.name for r in routing.lookup_range(points, ranges, "at").collect()}
    assert got == {0: None, 5: "r", 9: "r", 10: None, None: None}


def test_oversized_pieces_join_again(spark):
    text = "ä" * 25
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, t string")
    got = encode.oversized_updates(rows, "t`x", "id", "t", 20).orderBy("chunk").collect()
    assert [r.n_bytes for r in got] == [20, 20, 10] and all(r.sql.startswith("UPDATE `t``x` SET") for r in got)
    import base64
    import re

    assert b"".join(base64.b64decode(re.search("64[(]'([^']*)'", r.sql)[1]) for r in got).decode() == text
    with pytest.raises(ValueError):
        encode.oversized_updates(rows, "t", "", "t", 20)


def test_sizes_and_sniff(spark):
    got = [r.b for r in spark.createDataFrame([("16M",), (" 2k ",), ("512",), ("x",), ("",), (None,), ("1G",)], "s string").select(encode.bytes_of(F.col("s")).alias("b")).collect()]
    assert got == [16 << 20, 2048, 512, None, None, None, 1 << 30]
    sniff = [r.t for r in spark.createDataFrame([("a\tb\n",), ("a\x01",)], "s string").select(encode.is_text(F.col("s")).alias("t")).collect()]
    assert sniff == [True, False]
    edge = [r.t for r in spark.createDataFrame([("a\f",), ("a\x7f",), ("",), ("x" * 64 + "\x01",), (None,)], "s string").select(encode.is_text(F.col("s")).alias("t")).collect()]
    assert edge == [True, False, False, True, None]


def test_dump_rewrites_payloads_only(spark):
    rows = spark.createDataFrame([(1, "see https://old.test/a"), (2, "no link"), (3, None)], "id int, post_content string")
    dump = encode.insert_statements(rows, "wp_posts", ["id"], parts=1)
    new = sqltext.rewritten(dump, [("https://old.test", "https://new.test")])
    cells = [c["value"] for r in new.collect() for c in sqltext.cells(r.sql) if c["column"] == "post_content"]
    assert cells == ["see https://new.test/a", "no link", None]


def test_dump_round_trip_through_sqlite(spark):
    """INSERTs with placeholders and the UPDATEs that fill them give the same rows, of all types, in another engine."""
    import base64
    import datetime
    import sqlite3

    day = datetime.date(2020, 2, 29)
    rows = [(1, "it's; `x`", day, True, 1.5, bytearray(b"\x00\xff"), "L" * 100), (2, "", None, False, float("nan"), None, "short"), (3, None, day, None, -2.0, bytearray(b""), None)]
    df = spark.createDataFrame(rows, "id int, name string, day date, ok boolean, x double, raw binary, big string")
    inserts = encode.insert_statements(encode.with_placeholders(df, "big", 30), "t", ["id"], parts=2)
    updates = encode.oversized_updates(df, "t", ["id", "name"], "big", 30).orderBy("chunk")
    con = sqlite3.connect(":memory:")
    con.create_function("FROM_BASE64", 1, base64.b64decode)
    con.create_function("CONCAT", 2, lambda a, b: (a.encode() if isinstance(a, str) else a) + b)
    con.execute("CREATE TABLE t (id, name, day, ok, x, raw, big)")
    moved = sqltext.rewritten(inserts.select("sql").union(updates.select("sql")), [("https://a.test", "https://b.test")])
    for r in moved.collect():
        con.execute(r.sql)
    plain = lambda v: v.decode("latin-1") if isinstance(v, (bytes, bytearray)) else v
    got = sorted(tuple(map(plain, r)) for r in con.execute("SELECT * FROM t"))
    assert got == [(1, "it's; `x`", "2020-02-29", 1, 1.5, "\x00\xff", "L" * 100), (2, "", None, 0, None, None, "short"), (3, None, "2020-02-29", None, -2.0, "", None)]


def test_payloads_inside_expressions():
    import base64

    b = lambda s: base64.b64encode(s.encode()).decode()
    old, new = b("https://old.test/a"), b("https://new.test/a")
    edit = lambda s, content: s.replace("old", "new") + ("" if content is None else "!" * (content == "block_markup"))
    shape = "UPDATE wp_options SET v = CONCAT(v, FROM_BASE64('{0}')) WHERE k = FROM_BASE64('{0}');"
    assert sqltext.rewrite_statement(shape.format(old), edit) == shape.format(new)
    shape = "INSERT INTO t (`a,b)`, c) VALUES (IF(1, ')', FROM_BASE64('{0}')), 2), ROW(NULL, LOWER(FROM_BASE64('{0}'))) ON DUPLICATE KEY UPDATE c = VALUES(c), `a,b)` = FROM_BASE64('{0}');"
    assert sqltext.rewrite_statement(shape.format(old), edit) == shape.format(new)
    assert [(c["row_no"], c["column"], c["kind"]) for c in sqltext.cells(shape.format(old))] == [(0, "a,b)", "expression"), (0, "c", "number"), (1, "a,b)", "null"), (1, "c", "expression")]
    post = f"UPDATE `wp_posts` SET post_title = 'x', post_content = CONCAT(post_content, FROM_BASE64('{old}'));"
    assert b("https://new.test/a!") in sqltext.rewrite_statement(post, edit)
    inside = f"INSERT INTO t (a) VALUES ('FROM_BASE64(''{old}'')');"
    assert sqltext.rewrite_statement(inside, edit) == inside


def test_rules_with_slashes_and_one_url_key(spark):
    p = spark.createDataFrame([("/a/b",), ("/a",), ("/ab",), ("/a/",)], "path string")
    rules = spark.createDataFrame([("/", "/root/"), ("/a/", "/x/")], "source string, target string")
    assert {r.path: r.moved for r in routing.remapped(p, rules).collect()} == {"/a/b": "/x/b", "/a": "/x", "/ab": "/root/ab", "/a/": "/x/"}
    none = spark.createDataFrame([], "prefix string")
    assert routing.only(p, none).count() == 4 and routing.only(p, spark.createDataFrame([("/a/",)], "prefix string")).count() == 3
    m = spark.createDataFrame([(0, "https://X.test:443/", "https://n.test/q/")], "ord int, `from` string, `to` string")
    u = spark.createDataFrame([("https://x.TEST/a?U=1",), ("http://x.test/a",), ("https://x.test:443",), ("https://x.test:8443/",)], "url string")
    assert {r.url: r.new_url for r in routing.first_mapping(u, m).collect()} == {
        "https://x.TEST/a?U=1": "https://n.test/q/a?U=1", "http://x.test/a": "http://x.test/a", "https://x.test:443": "https://n.test/q", "https://x.test:8443/": "https://x.test:8443/",
    }


def test_null_keys_of_a_diff(spark):
    a = spark.createDataFrame([(1, "x"), (None, "x")], "k int, v string")
    got = sorted((str(r.k), r.op) for r in snapshots.diff(a, spark.createDataFrame([(1, "y"), (None, "z")], "k int, v string"), "k", ["v"]).collect())
    assert got == [("1", "change"), ("None", "add"), ("None", "delete")]


def test_few_and_many_rules_agree(spark):
    p = spark.createDataFrame([("/a/b",), ("/a",), ("/ab",), ("/a/",), ("/",), (None,), ("/c//d",)], "path string")
    rules = spark.createDataFrame([("/", "/r"), ("/a/", "/x"), ("/a", "/w"), ("/c/", None), ("/a/b/c", "/y")], "source string, target string")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(routing.longest_prefix(p, rules)) == rows(routing.longest_prefix(p, rules, few=0))
    own = rules.where("source <> '/'").select(F.col("source").alias("prefix"))
    for how in ("left_semi", "left_anti"):
        assert rows(routing.under_any(p, own, how=how)) == rows(routing.under_any(p, own, how=how, few=0))
    m = spark.createDataFrame([(2, "https://x.test", "https://n.test/q"), (1, "https://x.test/a/", "https://n.test/a"), (0, "https://x.test/a/b", "https://n.test/b/")], "ord int, `from` string, `to` string")
    u = spark.createDataFrame([("https://x.test/a/b?c",), ("https://x.test/a",), ("https://X.test:443/z#/a/b",), ("https://y.test/",), (None,)], "url string")
    assert rows(routing.first_mapping(u, m)) == rows(routing.first_mapping(u, m, few=0))
    plan = routing.longest_prefix(p, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_ranges_of_any_length(spark):
    rng = random.Random(8)
    ranges = [(0, 10**9, "all")] + [(s, s + rng.choice([1, 1, 2, 3, 8, 100, 5000]), f"r{i}") for i, s in enumerate(rng.randrange(-50, 10**6) for _ in range(3000))] + [(5, 5, "none"), (9, 3, "back"), (None, 4, "x")]
    points = [(k, rng.randrange(-60, 10**6)) for k in range(300)] + [(300, None), (301, 2 * 10**9), (302, 2 * 10**9), (302, 2 * 10**9)]
    want = sorted((k, at, n) for k, at in points for n in ([n for a, b, n in ranges if at is not None and a is not None and a <= at < b] or [None]))
    r, p = spark.createDataFrame(ranges, "start long, stop long, name string"), spark.createDataFrame(points, "_point int, at int")
    for few in (10_000, 5, 0):
        assert sorted(map(tuple, routing.lookup_range(p, r, "at", few).collect()), key=str) == sorted(want, key=str)
    assert routing.lookup_range(p, r.limit(0), "at").where("name IS NOT NULL").count() == 0


def test_a_million_ranges_under_one(spark):
    small = spark.range(1_000_000).selectExpr("id * 1000 AS start", "id * 1000 + 10 AS stop", "CAST(id AS STRING) AS name")
    ranges = small.unionByName(spark.createDataFrame([(0, 10**9, "all")], "start long, stop long, name string"))
    points = spark.range(50_000).selectExpr("id * 19999 AS at")
    got = routing.lookup_range(points, ranges, "at").groupBy().agg(F.count("*"), F.sum(F.when(F.col("name") != "all", 1)), F.sum(F.when(F.col("name") == F.floor(F.col("at") / 1000).cast("string"), 1))).first()
    inside = sum(k * 19999 % 1000 < 10 for k in range(50_000))
    assert tuple(got) == (50_000 + inside, inside, inside)


def test_few_rules_and_many_have_one_schema(spark):
    p = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    rules = spark.createDataFrame([("/a", 1), ("/a/b", 2)], "source string, target int")
    few, many = routing.longest_prefix(p, rules), routing.longest_prefix(p, rules, few=0)
    assert few.schema["target"].dataType == many.schema["target"].dataType == rules.schema["target"].dataType
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_document_leaves_and_drift(spark):
    rows = [(1, '{"a": {"b": [1, 2.50, {"c": null}], "e": {}}, "k.x": "q\\"", "l": []}'), (2, "[]"), (3, "not json"), (4, None), (5, "7")]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = {(r.key, r.path): r.value for r in reports.leaves(df, "id", "doc").collect()}
    assert got == {
        (1, "$.a.b[0]"): "1", (1, "$.a.b[1]"): "2.5", (1, "$.a.b[2].c"): "null", (1, "$.a.e"): "{}", (1, "$.k.x"): '"q\\""', (1, "$.l"): "[]", (2, "$"): "[]", (5, "$"): "7",
    }
    after = spark.createDataFrame([(1, '{"a": {"b": [1, 3], "e": 1}, "k.x": "q\\"", "l": []}'), (6, "{}")], "id int, doc string")
    found = {(r.key, r.path): (r.op, r.old, r.new) for r in reports.drift(df, after, "id", "doc").collect()}
    assert found == {
        (1, "$.a.b[1]"): ("change", "2.5", "3"), (1, "$.a.b[2].c"): ("remove", "null", None), (1, "$.a.e"): ("change", "{}", "1"), (2, "$"): ("remove", "[]", None), (5, "$"): ("remove", "7", None), (6, "$"): ("add", None, "{}"),
    }
    assert reports.drift(df, df, "id", "doc").count() == 0
