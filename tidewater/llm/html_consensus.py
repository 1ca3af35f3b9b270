"""HTML extraction by consensus host paths.

A page is read once; its blocks of text have owners, the nearest containers around them. A container is known by its generalised
path: tags with their first class, digits left out, from the root. Every path of a page is scored by
the share of the page's weight it holds times its density, the weight over all its text. The weight of a block is its length less
twice the part in links, and less for short ones; ``<article>`` and ``<main>`` count for more. In Spark every
scored path of a page votes for its host with its score over the page's best; the page is then extracted again from the elements at the
path with most votes, unless those hold less than half of what the page's own best path holds. A
page without such an element, and one without a host, uses its own.

The host table is joined by broadcast only where it has few rows, as counted; else by shuffle.

Defined cases: null or empty html gives an empty text; a null url has no host; repeated rows each
get their row; extra columns are ignored; the whole html is read, nothing is capped; hidden elements are not shown; time and
memory are in proportion to the page, whatever it leaves open or nests.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.markup import RAW, attributes, tokens

from .common import maybe_broadcast, small_batches, staged

_DIGITS = re.compile(r"\d+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

# Fixed values of HTML: elements without content, and elements that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = set("article body center dd div fieldset figure html main section td".split())
#: Elements that never hold article text.
SKIP = set("aside audio button canvas datalist dialog embed footer form head header iframe input map menu nav noscript object option script select style svg template textarea title video".split())
#: Those of them inside a block.
NEVER = SKIP - BLOCK
#: Elements that are not shown as text of the page.
HIDDEN = set("audio canvas datalist iframe object script style template title video".split())
#: Classes, ids and roles, as whole words, of blocks that are not article text.
SKIP_NAMES = set(
    "ad ads adv advert advertisement adverts advertising alertdialog aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer footers form gdpr header headers login masthead menu menubar menus modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promos related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets "
    "adsbygoogle commentlist cookiebanner outbrain sharebar taboola topnav".split()
)
#: Words that may be joined to such a name ("site-footer"); a name with any other word ("has-sidebar") tells of something else.
SITE = set("bar bottom desktop fixed global inner main mobile outer primary secondary site sticky top wrap wrapper".split())
JOINED = SITE | set(
    "area article articles block body box button buttons container entry group icons item items left link links list message page panel post posts reader "
    "readers right section slot text thread title unit user users zone".split()
)
_WORD = re.compile("[^a-z]+")


def furniture(names: list[str]) -> bool:
    """Whether a name is one of ``SKIP_NAMES``, or such names joined with words that say where or what kind.

    A header is the page's only by the words of ``SITE``: the header of a section is the article's.
    """
    for name in names:
        parts = {p for p in _WORD.split(name) if p}
        skip = parts & SKIP_NAMES
        if name in SKIP_NAMES or skip and parts - skip <= (SITE if skip <= {"header", "headers"} else JOINED):
            return True
    return False


#: Blocks of fewer characters weigh less than their length.
SHORT = 160
#: How much more the elements of the page's own article count.
MARKED = {"article": 1.5, "main": 1.25}
#: Where the search for an open element of the same kind ends.
SCOPE = CONTAINER | set("ul ol dl table tr".split())
LIKE = set("li dt dd option tr td th".split())


class Paths:
    """The generalised paths of a page, each a step beyond its parent; 0 is the root."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, str], int] = {}
        self.up, self.step, self.name = [0], [""], [b""]

    def below(self, parent: int, step: str) -> int:
        k = self.of.setdefault((parent, step), len(self.up))
        if k == len(self.up):
            self.up.append(parent)
            self.step.append(step)
            self.name.append(hashlib.blake2b(self.name[parent] + step.encode("utf-8", "replace"), digest_size=16).digest())
        return k

    def digest(self, k: int) -> str:
        return self.name[k].hex()

    def shown(self, k: int, most: int = 64) -> str:
        """The last steps of a path, for people."""
        out = []
        while k and len(out) < most:
            out.append(self.step[k])
            k = self.up[k]
        return ">".join(reversed([*out, "..."] if k else [*out, ""]))


class Element:
    __slots__ = ("name", "path", "skip", "link", "container", "soft", "article", "up", "chars", "score", "holds", "keep")

    def __init__(self, name: str, path: int, skip: bool, link: bool, soft: bool, article: bool, up: Element | None) -> None:
        self.name, self.path, self.skip, self.link, self.soft, self.article = name, path, skip, link, soft, article
        #: The nearest element around it that is a container or soft.
        self.up = up
        self.container = name in CONTAINER or up is None
        self.chars, self.score, self.holds, self.keep = 0, 0.0, False, False


class Page:
    """What ``walk`` reads: containers and soft elements in order, blocks (text, nearest of those, share of text in links), paths."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.nodes: list[Element] = []
        self.blocks: list[tuple[str, Element, float]] = []
        self.titles: list[str] = []
        self.links: list[str] = []


def _hidden(names: dict[str, str]) -> bool:
    return "hidden" in names or names.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(names.get("style", "")))


def walk(source: str | None, whole: bool = False) -> Page:
    """Read a page.

    Soft elements are blocks that look like what is no article text; ``clean`` drops them. With ``whole`` there are
    none, and all text that a page shows is given, with its titles and links.
    """
    page = Page()
    root = Element("", 0, False, False, False, False, None)
    stack, page.nodes = [root], [root]
    #: Depths of the open elements by name, and in every open scope the depth of its element and of those in it that the next like one ends.
    depths: dict[str, list[int]] = {}
    scopes: list[tuple[int, str, dict[str, int]]] = [(0, "", {})]
    buffer: list[str] = []
    linked = 0
    s = source or ""

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            buffer.clear()
            if text:
                top = stack[-1]
                page.blocks.append((text, top if top.container or top.soft else top.up, min(1.0, linked / len(text))))
            linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        top = stack[-1]
        if piece and not top.skip:
            buffer.append(piece)
            if top.link:
                linked += len(piece.strip())

    def close(depth: int) -> None:
        """Leave the elements from ``depth`` on."""
        if any(e.name in BLOCK for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            depths[e.name].pop()
        del stack[depth:]
        while scopes[-1][0] >= depth:
            scopes.pop()

    def end_like(name: str) -> None:
        """A block ends an open paragraph; items, cells and such end their like."""
        depth, scope, inside = scopes[-1]
        ends = ["p", *([name] if name in LIKE else []), *(["head"] if name == "body" else [])]
        found = [d for e in ends if (d := inside.get(e, -1)) > depth and d < len(stack) and stack[d].name == e]
        if found:
            close(max(found))
        elif scope == name and name in LIKE:
            close(depth)

    at, raw, title = 0, tuple(r for r in RAW if not (whole and r == "noscript")), None
    for start, end, name, closing, first, last in tokens(s, raw):
        if title is not None:
            page.titles.append(s[title:start])
            title = None
        text(s[at:start])
        at = end
        if name[0] == "!":
            continue
        if closing:
            if depths.get(name):
                close(depths[name][-1])
            elif name == "p":
                flush()
            continue
        if name in BLOCK:
            if name != "br":
                end_like(name)
            flush()
        up, names = stack[-1], {}
        if first < last:
            for k, a, b in attributes(s, first, last):
                if k in ("class", "id", "role", "hidden", "aria-hidden", "style", "href"):
                    names.setdefault(k, s[a:b])
        if whole and name == "a" and "href" in names and not up.skip:
            page.links.append(html_lib.unescape(names["href"]))
        if name in VOID:
            continue
        skip = up.skip or name in (HIDDEN if whole else NEVER) or _hidden(names)
        # The headline of an article may stand in a header of its own.
        soft = not whole and name in SKIP and name in BLOCK and name not in raw and not (name == "header" and up.article)
        kind = ""
        for k in ("class", "id", "role"):
            value = names.get(k, "").lower().split()
            if not whole and name in BLOCK and name not in ("html", "body", "article", "main") and furniture(value):
                soft = True
            if k == "class" and value:
                kind = "." + _DIGITS.sub("", value[0])
        path = page.paths.below(up.path, name + kind) if name in BLOCK else up.path
        if s.startswith("/", last - 1) and last > first and name not in BLOCK and name != "a" and name not in raw:
            continue
        e = Element(name, path, skip or name in raw and not (whole and name in ("textarea", "xmp")), up.link or name == "a", soft, up.article or name == "article", up if up.container or up.soft else up.up)
        depth = len(stack)
        stack.append(e)
        depths.setdefault(name, []).append(depth)
        if name in SCOPE:
            scopes.append((depth, name, {}))
        elif name == "p" or name in LIKE or name == "head":
            scopes[-1][2][name] = depth
        if e.container or soft:
            page.nodes.append(e)
        if whole and name == "title":
            title = at
    if title is not None:
        page.titles.append(s[title:])
    text(s[at:])
    flush()
    return page


def clean(source: str | None) -> Page:
    """As ``walk``, without the blocks of soft elements.

    A soft element stays where it holds the page's article: all the ``<article>`` (else ``<main>``) elements
    are inside soft ones, it being one; or, where there are none, it holds over half of the text.
    """
    page = walk(source)
    nodes = page.nodes
    if any(e.soft for e in nodes):
        for text, owner, _ in page.blocks:
            owner.chars += len(text)
        # Inside a soft element, from the root down; ``keep`` marks it for now.
        for e in nodes[1:]:
            e.keep = e.soft or e.up.keep
        marks = [e for e in nodes if e.name == "article"] or [e for e in nodes if e.name == "main"]
        free = any(not e.keep for e in marks)
        for e in marks:
            e.holds = True
        for e in reversed(nodes[1:]):
            e.up.chars += e.chars
            e.up.holds = e.up.holds or e.holds
        most = nodes[0].chars / 2
        for e in nodes[1:]:
            stays = not free and (e.holds if marks else e.chars > most)
            e.skip = e.up.skip or e.soft and not stays
        page.blocks = [b for b in page.blocks if not b[1].skip]
    return page


def weight(text: str, links: float) -> float:
    """What a block counts for its containers."""
    n = len(text)
    return n * max(0.0, 1 - 2 * links) * min(1.0, n / SHORT)


def scores(page: Page) -> dict[int, float]:
    """Score of every path that holds text: its share of the page's weight times its density. Of paths that hold the same the innermost stands for all."""
    for e in page.nodes:
        e.chars, e.score = 0, 0.0
    for text, owner, links in page.blocks:
        owner.chars += len(text)
        owner.score += weight(text, links)
    for e in reversed(page.nodes[1:]):
        e.up.chars += e.chars
        e.up.score += e.score
    total = page.nodes[0].score
    held: dict[int, list[float]] = defaultdict(lambda: [0.0, 0, 1.0])
    for e in page.nodes:
        if e.container and e.chars:
            h = held[e.path]
            h[0] += e.score
            h[1] += e.chars
            h[2] = max(h[2], MARKED.get(e.name, 1.0))
    out: dict[int, float] = {}
    same: dict[int, tuple[float, float]] = {}
    for k in sorted(held, reverse=True):  # a path comes after its parent
        score, chars, more = held[k]
        # Without any weight, as of a page of links and single words, the text itself counts.
        value = more * (score / total * score / chars if total else chars / page.nodes[0].chars)
        up = page.paths.up[k]
        while up and up not in held:
            up = page.paths.up[up]
        if same.get(k) != (score, chars) or more > 1:
            out[k] = value
        same.setdefault(up, (score, chars))
    return out


def best_path(page: Page, found: dict[int, float]) -> int | None:
    """The path of the highest score, the innermost among equals; None where nothing is held."""
    return max(found, key=lambda k: (round(found[k], 9), k)) if found else None


def votes(source: str | None) -> dict[str, tuple[float, str]]:
    """The page's votes: digest of a path -> its score over the best one, and the path's last steps."""
    page = clean(source)
    found = scores(page)
    most = max(found.values(), default=0.0)
    return {page.paths.digest(k): (v / most, page.paths.shown(k)) for k, v in found.items() if 4 * v >= most > 0}


def _at(page: Page, path: int) -> list[str]:
    """Texts of the blocks inside containers at ``path``."""
    for e in page.nodes:
        e.keep = e.container and e.path == path or e.up is not None and e.up.keep
    return [text for text, owner, _ in page.blocks if owner.keep]


def extract(source: str | None, path: str | None) -> str:
    """Text of the blocks inside elements at the path of this digest; where they hold little or nothing, of the page's own best path."""
    page = clean(source)
    best = best_path(page, scores(page))
    own = [text for text, *_ in page.blocks] if best is None else _at(page, best)
    if path:
        theirs = next((k for k in range(len(page.paths.up)) if page.paths.digest(k) == path), None)
        if theirs is not None and theirs != best:
            kept = _at(page, theirs)
            if kept and 2 * sum(map(len, kept)) >= sum(map(len, own)):
                return "\n".join(kept)
    return "\n".join(own)


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _poll(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in parts:
        total: dict[tuple[str, str], float] = defaultdict(float)
        steps: dict[str, str] = {}
        for host, source in zip(x.host, x.html, strict=True):
            for path, (share, shown) in votes(source).items():
                total[host, path] += share
                steps[path] = shown
        yield pd.DataFrame([(h, p, steps[p], v) for (h, p), v in total.items()], columns=["host", "path", "shown", "share"])


def winners(pages: DataFrame) -> DataFrame:
    """host, path (a digest), shown (its last steps): the path with the most votes, the first by digest among equals."""
    polled = pages.select(host_of("url").alias("host"), "html").where("host <> ''").mapInPandas(_poll, "host string, path string, shown string, share double")
    total = polled.groupBy("host", "path").agg(F.first("shown").alias("shown"), F.round(F.sum("share"), 6).alias("share"))
    best = total.groupBy("host").agg(F.min_by(F.struct("path", "shown"), F.struct(-F.col("share"), F.col("path"))).alias("best"))
    return best.select("host", "best.*")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in parts:
        out = [extract(source, path if isinstance(path, str) else None) for source, path in zip(x.html, x.path, strict=True)]
        yield pd.DataFrame({"page_id": x.page_id, "url": x.url, "text": out, "n_chars": [len(t) for t in out]})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession, 500)
    best = maybe_broadcast(staged(winners(pages).select("host", "path"), "html-winners"))
    p = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    return p.join(best, "host", "left").select("page_id", "url", "html", "path").mapInPandas(
        _read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    )
