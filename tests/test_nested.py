"""Golden vectors and properties of the formats that SQL cannot parse."""

import base64
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.functions import nested
from tidewater.sources import sqltext

R = nested.Rewriter([("https://old.example.com", "https://new.test/site"), ("http://old.example.com", "https://new.test/site")])


def php(s: str) -> str:
    return f's:{len(s.encode())}:"{s}";'


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("go to https://old.example.com/a, now", "go to https://new.test/site/a, now"),
        ("https://OLD.example.com/a", "https://new.test/site/a"),
        ("HTTP://OLD.EXAMPLE.COM/a", "HTTP://OLD.EXAMPLE.COM/a"),
        ("https://old.example.com.evil.test/", "https://old.example.com.evil.test/"),
        ("https://x.test/?u=https://old.example.com/", "https://x.test/?u=https://old.example.com/"),
        (php("https://old.example.com/é"), php("https://new.test/site/é")),
        ("a:1:{" + php("https://old.example.com/k") + php("https://old.example.com/v") + "}", "a:1:{" + php("https://old.example.com/k") + php("https://new.test/site/v") + "}"),
        ('{"n": 1.50, "e": {}, "u": "https://old.example.com/"}', '{"n": 1.50, "e": {}, "u": "https://new.test/site/"}'),
        ('s:5:"https://old.example.com/";', 's:5:"https://new.test/site/";'),
    ],
)
def test_rewrite(value, want):
    assert R.value(value) == want


def test_nested_both_ways():
    inner = json.dumps({"u": "https://old.example.com/x"})
    assert R.value(php(inner)) == php(json.dumps({"u": "https://new.test/site/x"}))
    assert json.loads(R.value(json.dumps([php("https://old.example.com/x")]))) == [php("https://new.test/site/x")]


def test_markup():
    text = '<!-- wp:image {"url":"https://old.example.com/i.png"} --><img src="https://old.example.com/i.png"><!-- /wp:image -->'
    assert R.value(text, "block_markup") == text.replace("https://old.example.com", "https://new.test/site")
    assert R.value(text, "skip") is text


def test_custom_objects_pass_through():
    value = 'a:2:{i:0;C:3:"Box":4:{http}i:1;' + php("https://old.example.com/") + "}"
    assert R.value(value) == 'a:2:{i:0;C:3:"Box":4:{http}i:1;' + php("https://new.test/site/") + "}"


def test_leaves_and_origins():
    assert [x[2] for x in nested.leaves('a:2:{s:1:"a";s:3:"one";s:1:"b";s:10:"{"k":"v"} ";}')] == ["one", "v"]
    assert nested.origins_in('text https://no.test/ <img src="https://yes.test/i.png"> <a href="https://no.test/">') == ["https://yes.test"]
    assert nested.origins_in("http://whole.test:8080/x") == ["http://whole.test:8080"]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.text(max_size=8) | st.integers() | st.booleans() | st.none(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3)))
def test_untouched_json_is_the_same_object(value):
    text = json.dumps(value)
    assert nested.json_edit(text, lambda s: s) is text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["SELECT 'a;b'", 'INSERT INTO t VALUES ("x\\";", `y;`)', "/* ; */ SELECT 1", "-- c;\nSELECT 2", "UPDATE t SET a='it''s;'"]), max_size=5), st.integers(1, 7))
def test_splitter_does_not_depend_on_chunks(parts, size):
    text = "".join(p + ";\n" for p in parts)
    whole = [x[2] for x in sqltext.split(text)]
    splitter, got = sqltext.Splitter(), []
    for i in range(0, len(text), size):
        got += splitter.feed(text[i : i + size])
    assert got + splitter.feed("", last=True) == whole and len(whole) == len(parts)


def test_statement_rewrite_keeps_the_rest():
    b = lambda s: base64.b64encode(s.encode()).decode()
    sql = f"INSERT INTO `wp_posts` (`ID`, `post_content`) VALUES (1, FROM_BASE64('{b('https://old.example.com/')}')), (2, CONVERT(FROM_BASE64('{b('plain')}') USING utf8mb4));"
    assert sqltext.rewrite_statement(sql, R.value) == sql.replace(b("https://old.example.com/"), b("https://new.test/site/"))
    assert sqltext.rewrite_statement("CREATE TABLE t (a int);", R.value) == "CREATE TABLE t (a int);"
    assert [(c["row_no"], c["column"], c["kind"]) for c in sqltext.cells(sql)] == [(0, "ID", "number"), (0, "post_content", "base64"), (1, "ID", "number"), (1, "post_content", "base64")]
    assert sqltext.cells("INSERT INTO t SELECT 1") is None


def test_spark_functions(spark):
    df = spark.createDataFrame([(1, "https://old.example.com/a"), (2, None), (3, "no")], "i int, v string")
    out = {r.i: r.w for r in df.select("i", nested.rewrite(df.v, [("https://old.example.com", "https://n.test")]).alias("w")).collect()}
    assert out == {1: "https://n.test/a", 2: None, 3: "no"}


def test_depth_has_no_bound():
    url, new = "https://old.example.com/v", "https://new.test/site/v"
    deep = lambda u: "a:1:{i:0;" * 5000 + php(u) + "}" * 5000
    assert R.value(deep(url)) == deep(new)
    inside = php(url)
    for _ in range(100):
        inside = php(inside)
    want = php(new)
    for _ in range(100):
        want = php(want)
    assert R.value(inside) == want


def test_statements_longer_than_two_mebibytes():
    long = "INSERT INTO t VALUES ('" + "x;" * (2 << 20) + "');"
    splitter = sqltext.Splitter()
    assert splitter.feed(long[:100]) + splitter.feed(long[100:]) + splitter.feed("\nSELECT 1;") + splitter.feed("", last=True) == [long, "\nSELECT 1;"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<a href="http&#58;//old.example.com/a?x=1&amp;y=2">t</a>', '<a href="https://new.test/site/a?x=1&amp;y=2">t</a>'),
        ('<a href="//old.example.com/b" title="//old.example.com/b">', '<a href="//new.test/site/b" title="//old.example.com/b">'),
        ('<img srcset="https://old.example.com/1.png 1x, //old.example.com/2.png 2x,https://x.test/,c 3x">', '<img srcset="https://new.test/site/1.png 1x, //new.test/site/2.png 2x,https://x.test/,c 3x">'),
        ('<p style="background:url(//old.example.com/i.png)">see http&#x3a;//old.example.com/z &copy; &lt;', '<p style="background:url(//new.test/site/i.png)">see https://new.test/site/z &copy; &lt;'),
        ('<script>var u="https:\\/\\/old.example.com\\/p";</script>', '<script>var u="https:\\/\\/new.test\\/site\\/p";</script>'),
        ('<div data-j="{&quot;u&quot;:&quot;https://old.example.com/q&quot;}">', '<div data-j="{&quot;u&quot;:&quot;https://new.test/site/q&quot;}">'),
        ("<style>a{b:url('https://old.example.com/s.css')}</style>", "<style>a{b:url('https://new.test/site/s.css')}</style>"),
        ("<A HREF= https://old.example.com/x >https://old.example.com/?a=1&copy=2</A>", "<A HREF= https://new.test/site/x >https://new.test/site/?a=1&copy=2</A>"),
        ("<!-- https://old.example.com/ --><p>a < b https://old.example.com.evil.test/", "<!-- https://new.test/site/ --><p>a < b https://old.example.com.evil.test/"),
        ("<a href='//other.test/https://old.example.com/'>", "<a href='//other.test/https://old.example.com/'>"),
        ("<a title='\"https://old.example.com/\"' href=x>", "<a title='\"https://new.test/site/\"' href=x>"),
    ],
)
def test_markup_is_edited_in_place(text, want):
    assert R.value(text, "block_markup") == want
    assert R.value(want, "block_markup") is want


def test_json_of_any_depth():
    deep = lambda u: '{"a":[' * 60_000 + f'"{u}"' + "]}" * 60_000
    assert R.value(deep("https://old.example.com/v")) == deep("https://new.test/site/v")
    for bad in ("[" * 60_000, "[" * 60_000 + "1," + "]" * 60_000, '{"a":[' * 60_000 + "]]" * 60_000, "[" * 60_000 + "1]]" + "]" * 60_000, "[" * 60_000 + '{"a" 1}' + "]" * 60_000):
        with pytest.raises(ValueError):
            nested.json_edit(bad, lambda s: s)


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.text(max_size=4) | st.floats() | st.integers() | st.booleans() | st.none(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)), st.integers(0, 30), st.sampled_from('{}[],:"1e. '))
def test_json_is_checked_as_the_parser_does(value, at, mark):
    text = json.dumps(value)
    for t in (text, text[:at] + mark + text[at:], text[:at] + text[at + 1 :]):
        outcome = []
        for check in (json.loads, lambda t: nested._json_checked("[" * 60_000 + t + "]" * 60_000)):
            try:
                check(t)
                outcome.append(True)
            except ValueError:
                outcome.append(False)
        # Inside brackets a list of values is fine, and so is nothing.
        assert outcome[0] == outcome[1] or t.strip() == "" or not outcome[0] and json.loads(f"[{t}]") is not None


def test_a_hundred_thousand_hosts_cost_as_much_as_ten():
    few, many = (nested.Rewriter([(f"https://h{i}.example.com", "https://n.test") for i in range(n)] + [("https://bücher.example.com", "https://b.test")]) for n in (10, 100_000))
    text = "text https://h5.example.com/a and https://other.test/b and https://xn--bcher-kva.example.com/c or https://BÜCHER.example.com/ " * 3000
    took = []
    for r in (few, many):
        began = time.process_time()
        out = r.value(text)
        took.append(time.process_time() - began)
        assert out.count("https://n.test/a") == 3000 and out.count("https://b.test/") == 6000 and "other.test/b" in out
    assert took[1] < 3 * took[0] + 0.1


def test_serialized_lists_are_edited():
    bits = [php("dir/one.php"), php("dirty/é.php"), php("other/x.php"), "i:5;", 'a:1:{i:0;' + php("dir/in") + "}", php("dir/é;}\"")]
    text = f"a:{len(bits)}:{{" + "".join(f"i:{n};{b}" for n, b in enumerate(bits)) + "}"
    kept = [bits[1], bits[2], bits[3], bits[4]]
    assert nested.php_without(text, lambda v: v.startswith("dir/")) == f"a:{len(kept)}:{{" + "".join(f"i:{n};{b}" for n, b in enumerate(kept)) + "}"
    assert nested.php_without(text, lambda v: v.startswith("none/")) is text
    for other in ("a:1:{i:0;s:3:\"ab\";}", "a:0:{}", "s:1:\"x\";", "", "text", text + "x", 'a:2:{i:0;i:1;}'):
        assert nested.php_without(other, lambda v: True) is other
    keyed = 'a:2:{s:1:"k";' + php("dir/a") + 's:1:"l";' + php("b") + "}"
    assert nested.php_without(keyed, lambda v: v.startswith("dir/")) == "a:1:{i:0;" + php("b") + "}"
