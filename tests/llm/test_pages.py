"""Pages read once: hostile pages in linear time and memory, an independent parser, and the vote of a host."""

import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from tidewater.functions import markup
from tidewater.llm import html_consensus, warc

TEXT = "Words that make up a paragraph of some length, with a stop. "
HOSTILE = {
    "links": "<a " * 330_000, "titles": "<title>" * 150_000, "declarations": "<!" * 500_000, "comments": "<!--" * 250_000, "blocks": "<div>" * 50_000 + "text" + "</div>" * 50_000,
    "headings": "<h1>" * 50_000, "ends": "<b>" * 50_000 + "</i>" * 50_000 + "<br>x" * 50_000, "quotes": '<a b=">"' * 100_000, "open quotes": '<a href="x' * 100_000,
    "scopes": "<dl><dt><ul>" + "<b>" * 50_000 + "<dt></dt>" * 50_000, "named": "<div class='a'><p>x" * 50_000, "ends without": "</p>" * 200_000, "values": "<a b=' " * 150_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    page = HOSTILE[name]
    began = time.process_time()
    html_consensus.extract(page, None)
    once = time.process_time() - began
    began = time.process_time()
    warc.derive("i", "t", "d", b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
    assert max(once, time.process_time() - began) < 6  # quadratic readers took minutes to hours


def test_deep_pages_take_linear_memory():
    tracemalloc.start()
    html_consensus.votes("<div class='a b'>" * 50_000 + "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and html_consensus.extract("<div class='a b'>" * 50_000 + "text", None) == "text"


class Independent(HTMLParser):
    """Start and end tags, attributes and comments by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, False, [(k, v or "") for k, v in attrs]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen.append((tag, True, []))

    def handle_comment(self, data):
        self.seen.append(("!--", False, data))


def ours(page):
    out = []
    for _, _, name, closing, a, b in markup.tokens(page):
        if name == "!--":
            out.append((name, False, page[a:b]))
        elif name != "!":
            import html

            out.append((name, closing, [] if closing else [(k, html.unescape(page[x:y])) for k, x, y in markup.attributes(page, a, b)]))
    return out


def test_tags_as_an_independent_parser_reads_them(spark):
    pages = [
        "<!DOCTYPE html><p class=a id='b c' data-x=\"1>2\">x<br/>y</p><!-- a > b --><script>if (a<b) '</p>'</script><img src=x alt='' hidden><a href = \"u\" >t</a>",
        "a < b <i>x</i> <3 <em\nclass='z'>y</em>",
        "<title>A title</title><textarea>text</textarea><td colspan=2 nowrap>1</td>",
    ]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for page in pages:
        parser = Independent()
        parser.feed(page)
        parser.close()
        assert ours(page) == parser.seen


def test_hidden_text_and_own_headlines():
    long = (TEXT * 5).strip()
    page = f"<body><article><header><h1>Headline</h1></header><p>{long}</p><div hidden>a</div><p style='color:red; display: none'>b</p><p aria-hidden=true>c</p><span hidden>d</span><footer>f</footer></article></body>"
    assert html_consensus.extract(page, None) == f"Headline\n{long}"
    assert warc.derive("i", None, None, page.encode())[1].block.decode() == f"Headline\n{long}\nf"


def page_of(n, *, article=True):
    """A page without ``<article>`` or telling names: unnamed columns beside the text, comments of unknown names below it."""
    paragraphs = "".join(f"<p>{TEXT * (3 + (n + k) % 4)}</p>" for k in range(5 if article else 0))
    side = "".join(f"<p>Buy our thing {n + k} now</p>" for k in range(4))
    return (
        f"<body><div class=left>{side}</div><div class='mid col{n}'><h2>Headline {n}</h2>{paragraphs}</div><div class=right>"
        + "".join(f"<div><a href=/{k}>News item {k}</a> soon</div>" for k in range(6)) + f"</div><div class=gb>{'<div>I agree with it ' + str(n) + '</div>'}</div></body>"
    )


def want_of(n):
    return "\n".join([f"Headline {n}", *((TEXT * (3 + (n + k) % 4)).strip() for k in range(5))])


def test_columns_beside_the_text_are_left_out():
    assert html_consensus.extract(page_of(3), None) == want_of(3)


def test_the_host_decides_where_a_page_is_unlike(spark):
    """A long column beside a short text: alone the page takes all, with its host the text."""
    long_side = "".join(f"<p>{TEXT * 4}</p>" for _ in range(4))
    odd = f"<body><div class=left>{long_side}</div><div class='mid col9'>{''.join(f'<p>{TEXT * 4}</p>' for _ in range(4))}</div></body>"
    rows = [(i, f"http://one.test/{i}", page_of(i)) for i in range(6)] + [(7, "http://one.test/7", odd), (8, "http://other.test/", odd)]
    got = {r.page_id: r.text for r in html_consensus.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == want_of(i) for i in range(6))
    assert got[7] == "\n".join([(TEXT * 4).strip()] * 4) and got[8] == "\n".join([(TEXT * 4).strip()] * 8)
    shown = {r.host: r.shown for r in html_consensus.winners(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert shown["one.test"] == ">body>div.mid"


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tidewater.llm import common

    unset = SimpleNamespace(get=lambda *_: None)
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        spark = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert common.shared_root(spark).startswith("file://")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                common.shared_root(spark)
