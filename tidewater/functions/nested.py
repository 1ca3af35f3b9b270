"""URLs inside nested strings: PHP-serialized data, JSON, block markup and plain text.

The format of a value is told by its first byte and then by parsing it; what does not parse is
text. Only string values are looked at, never keys. A value in which nothing changes comes back
as the same object, so untouched bytes stay as they were.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import markup as markup_reader

Edit = Callable[[str], str]


class Malformed(ValueError):
    """Not a serialized value."""


@dataclass
class _Php:
    """A reader of one serialized value that copies it out with edited strings (lengths are counted in bytes)."""

    data: bytes
    edit: Callable[[bytes], bytes]
    at: int = 0

    def until(self, mark: bytes) -> bytes:
        end = self.data.find(mark, self.at)
        if end < 0:
            raise Malformed
        out, self.at = self.data[self.at : end], end + len(mark)
        return out

    def expect(self, mark: bytes) -> None:
        if not self.data.startswith(mark, self.at):
            raise Malformed
        self.at += len(mark)

    def number(self, mark: bytes) -> int:
        digits = self.until(mark)
        if not digits.isdigit():
            raise Malformed
        return int(digits)

    def quoted(self) -> bytes:
        n = self.number(b":")
        self.expect(b'"')
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise Malformed
        self.at += n
        self.expect(b'"')
        return out

    def value(self) -> bytes:
        """The value, nested as deep as it is: what is open is counted, not recursed into."""
        out: list[bytes] = []
        left: list[int] = []  # keys and values to come, of each open array or object
        while True:
            entries = self.item(out, key=bool(left) and left[-1] % 2 == 0)
            if entries is None:
                if left:
                    left[-1] -= 1
            else:
                left.append(2 * entries)
            while left and not left[-1]:
                self.expect(b"}")
                out.append(b"}")
                left.pop()
                if left:
                    left[-1] -= 1
            if not left:
                return b"".join(out)

    def item(self, out: list[bytes], key: bool) -> int | None:
        """Copy one scalar, or the head of an array or object, to ``out``; gives the entries of the latter."""
        kind, start = self.data[self.at : self.at + 2], self.at
        self.at += 2
        if kind == b"s:":
            old = self.quoted()
            self.expect(b";")
            new = old if key else self.edit(old)
            out.append(self.data[start : self.at] if new is old else b's:%d:"%s";' % (len(new), new))
            return None
        if key and kind != b"i:":
            raise Malformed
        entries = None
        if kind in (b"i:", b"d:", b"b:", b"r:", b"R:"):
            body = self.until(b";")
            if not re.fullmatch(rb"[01]" if kind == b"b:" else rb"[+-]?\d+" if kind != b"d:" else rb"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|-?INF|NAN", body):
                raise Malformed
        elif kind == b"C:":
            self.quoted()
            self.expect(b":")
            n = self.number(b":")
            self.expect(b"{")
            self.at += n
            self.expect(b"}")
        elif kind in (b"a:", b"O:"):
            if kind == b"O:":
                self.quoted()
                self.expect(b":")
            entries = self.number(b":")
            self.expect(b"{")
        elif kind != b"N;":
            raise Malformed
        out.append(self.data[start : self.at])
        return entries


def php_edit(text: str, edit: Edit) -> str:
    """The serialized value with edited string values; raises ``Malformed``. Bytes beyond UTF-8 ride as surrogates."""
    data = text.encode("utf-8", "surrogateescape")

    def one(old: bytes) -> bytes:
        s = old.decode("utf-8", "surrogateescape")
        new = edit(s)
        return old if new is s or new == s else new.encode("utf-8", "surrogateescape")

    reader = _Php(data, one)
    out = reader.value()
    if reader.at != len(data):
        raise Malformed
    return text if out == data else out.decode("utf-8", "surrogateescape")


def php_entries(text: str) -> list[tuple[bytes, bytes]]:
    """Key and value, as written, of every entry of a serialized array; raises ``Malformed`` for anything else."""
    reader = _Php(text.encode("utf-8", "surrogateescape"), lambda old: old)
    reader.expect(b"a:")
    count = reader.number(b":")
    reader.expect(b"{")
    out = []
    for _ in range(count):
        key: list[bytes] = []
        reader.item(key, key=True)
        out.append((key[0], reader.value()))
    reader.expect(b"}")
    if reader.at != len(reader.data):
        raise Malformed
    return out


def php_without(text: str, drop: Callable[[str], bool]) -> str:
    """A serialized list without the strings that ``drop`` names, counted and numbered anew; other values stay as they are written, nested ones whole.

    The same object where nothing is dropped, and where the text is no serialized array.
    """
    try:
        entries = php_entries(text)
    except Malformed:
        return text
    kept = []
    for _, value in entries:
        if value[:2] == b"s:":
            mark = value.index(b'"')
            if drop(value[mark + 1 : -2].decode("utf-8", "surrogateescape")):
                continue
        kept.append(value)
    if len(kept) == len(entries):
        return text
    return (b"a:%d:{" % len(kept) + b"".join(b"i:%d;%b" % (n, v) for n, v in enumerate(kept)) + b"}").decode("utf-8", "surrogateescape")


def without(value: Column, folders: list[str]) -> Column:
    """Serialized lists without the paths that lie in one of the folders. Values that name none of them never reach Python."""
    under = tuple(f.rstrip("/") + "/" for f in folders)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: php_without(t, lambda v: v.startswith(under)), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    guard = F.lit(False)
    for f in under:
        guard |= F.contains(value, F.lit(f))
    return F.when(F.startswith(value, F.lit("a:")) & guard, F.pandas_udf(run, "string")(value)).otherwise(value)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?\d++)?+|true|false|null|NaN|-?Infinity))')


def _json_checked(text: str) -> None:
    """Whether the text is JSON of any depth; raises ``ValueError``."""
    try:
        json.loads(text)
        return
    except RecursionError:
        pass
    # What is open, and what may come: a value, the end of an empty one, a key, a colon, or a comma or end.
    opened: list[str] = []
    may, at = {"value"}, 0
    while m := _JSON_TOKEN.match(text, at):
        at, mark = m.end(), m[1]
        if mark in ("{", "[") and "value" in may:
            opened.append(mark)
            may = {"key", "end"} if mark == "{" else {"value", "end"}
            continue
        if mark == ":" and "colon" in may:
            may = {"value"}
            continue
        if mark == "," and "more" in may:
            may = {"key"} if opened[-1] == "{" else {"value"}
            continue
        if m[2] and "key" in may:
            may = {"colon"}
            continue
        if mark in ("}", "]") and "end" in may and opened[-1] == ("{" if mark == "}" else "["):
            opened.pop()
        elif mark or "value" not in may:
            raise ValueError(f"not JSON at {m.start()}")
        may = {"more", "end"} if opened else set()
    if opened or may or text[at:].strip(" \t\n\r"):
        raise ValueError(f"not JSON at {at}")


_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"')


_COLON = re.compile(r"\s*+:")


def json_edit(text: str, edit: Edit) -> str:
    """The JSON text with edited string values. Only the edited strings are written anew; numbers, spaces and {} stay."""
    _json_checked(text)
    out, last = [], 0
    for m in _JSON_STRING.finditer(text):
        if _COLON.match(text, m.end()):
            continue
        old = json.loads(m[0])
        new = edit(old)
        if new != old:
            out += [text[last : m.start()], json.dumps(new, ensure_ascii=False)]
            last = m.end()
    return "".join([*out, text[last:]]) if out else text


def parts_of(text: str) -> tuple[str, Callable[[str, Edit], str]] | None:
    """The name and the editor of the format that a value may have."""
    first = text.lstrip(" \t\r\n")[:1]
    if text[:1] in ("a", "s", "O", "C") and text[1:2] == ":":
        return "php", php_edit
    if first in ("{", "[", '"') and first:
        return "json", json_edit
    return None


def leaves(text: str | None) -> Iterator[tuple[str, int, str]]:
    """(formats on the way, ordinal, string) of every string value without a format of its own."""
    found: list[tuple[str, str]] = []

    def look(s: str, path: str) -> None:
        form = parts_of(s)
        if form:
            mark = len(found)

            def inner(x: str) -> str:
                look(x, f"{path}/{form[0]}")
                return x

            try:
                form[1](s, inner)
                return
            except (Malformed, ValueError):
                del found[mark:]
        found.append((path, s))

    if text is not None:
        try:
            look(text, "")
        except RecursionError:  # formats inside formats, too many to follow: one leaf
            found[:] = [("", text)]
    for n, (path, s) in enumerate(found):
        yield path, n, s


@dataclass(frozen=True)
class Base:
    """A parsed http(s) URL: what another must share to lie under it."""

    scheme: str
    host: str
    path: str
    raw: str

    @staticmethod
    def of(url: str) -> Base | None:
        try:
            u = urlsplit(url)
            port = u.port
        except ValueError:
            return None
        if u.scheme.lower() not in ("http", "https") or not u.hostname:
            return None
        host = u.hostname.lower()
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            pass
        standard = {"http": 80, "https": 443}[u.scheme.lower()]
        return Base(u.scheme.lower(), host if port in (None, standard) else f"{host}:{port}", u.path.rstrip("/"), url)

    def holds(self, other: Base) -> bool:
        """``other`` is of this origin and its path lies at or under this one, by whole segments."""
        return (self.scheme, self.host) == (other.scheme, other.host) and (other.path == self.path or other.path.startswith(self.path + "/"))


_URL = re.compile(r"https?://[^\s\"'<>()\[\]{}|\\^`]+", re.I)
_ESCAPED = re.compile(r"https?:(?:\\/){2}[^\s\"'<>()\[\]{}|^`]+", re.I)
_QUERY = re.compile(r"[?#]")
_COMMENT = re.compile(r"<!--\s*/?wp:([a-z0-9/-]+)\s*(\{.*?\})?\s*/?-->", re.S)
#: Hosts as they stand behind two slashes, plain or escaped.
_HOST = re.compile(r"/\\*+/(?:[^/?#@\s\"'<>\\]*+@)?([^/?#:\s\"'<>\\&,;)]++)")
_REFERENCE = re.compile(r"&(?:#\d++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;)")
_CSS_URL = re.compile(r"""\burl\(\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'()]++))\s*+\)""", re.I)
_CANDIDATE = re.compile(r"(?:^|(?<=[\s,]))(?![\s,])([^\s]*[^\s,])")

# Attributes whose value is one URL, and such of several.
URL_ATTRIBUTES = set("action archive background cite classid codebase data formaction href icon longdesc manifest poster profile src usemap xlink:href".split())
SETS = {"srcset", "imagesrcset"}


def _decoded(raw: str) -> tuple[str, list[int]]:
    """The text without character references, and the place in ``raw`` of every character and of the end."""
    out, places, last = [], [], 0
    for m in _REFERENCE.finditer(raw):
        plain = html_lib.unescape(m[0])
        out += [raw[last : m.start()], plain]
        places += [*range(last, m.start()), *[m.start()] * len(plain)]
        last = m.end()
    out.append(raw[last:])
    return "".join(out), [*places, *range(last, len(raw) + 1)]


class Rewriter:
    """Rewrites URLs under the first base of an ordered mapping that holds them. Bases are found by host, so their number costs nothing."""

    def __init__(self, mapping: list[tuple[str, str]]) -> None:
        self.bases = [(b, to.rstrip("/")) for source, to in mapping if (b := Base.of(source))]
        self.by_host: dict[str, list[tuple[Base, str]]] = {}
        for b, to in self.bases:
            name = b.host.split(":")[0]
            spelled = {name}
            try:
                spelled.add(name.encode().decode("idna").lower())
            except UnicodeError:
                pass
            for h in spelled:
                self.by_host.setdefault(h, []).append((b, to))
        self.hosts = set(self.by_host)

    def known(self, text: str, markup: bool = False) -> bool:
        """Whether a mapped host may stand in the text."""
        if "\\u" in text or markup and "&" in text:
            return True  # a host may be written with escapes
        return any(h in self.by_host for h in _HOST.findall(text.lower()))

    def url(self, url: str) -> str:
        """The URL under its new base; the same if no base holds it. What follows ? or # is kept as it is."""
        host = _HOST.search(url)
        if not host or not (bases := self.by_host.get(host[1].lower())):
            return url
        cut = m.start() if (m := _QUERY.search(url)) else len(url)
        plain, rest = url[:cut], url[cut:]
        own = Base.of(plain)
        for base, to in bases if own else ():
            if base.holds(own):
                u = urlsplit(plain)
                tail = u.path[len(base.path) :] if len(u.path) > len(base.path) else ""
                return to + tail + rest
        return url

    def reference(self, url: str) -> str:
        """A URL as an attribute has it: also one without a scheme, which then goes under a base of either scheme and stays without."""
        if not url.startswith("//"):
            return self.url(url)
        for scheme in ("https:", "http:"):
            new = self.url(scheme + url)
            if new != scheme + url:
                return new[new.index("//") :] if "//" in new else new
        return url

    def _tokens(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, new text) of every URL in a text that moves."""
        for m in _URL.finditer(text):
            token = m[0].rstrip(".,;:!?")
            # A URL inside another's query is not looked at: the token is the outer one.
            if (new := self.url(token)) != token:
                yield m.start(), m.start() + len(token), new
        if ":\\/\\/" in text:
            for m in _ESCAPED.finditer(text):
                token = m[0].rstrip("\\.,;:!?")
                plain = token.replace("\\/", "/")
                if "\\" not in plain and (new := self.url(plain)) != plain:
                    yield m.start(), m.start() + len(token), new.replace("/", "\\/")

    def text(self, text: str) -> str:
        """Plain text: URLs are found as tokens, with slashes escaped or not; closing punctuation is not theirs."""
        return _edited(text, self._tokens(text))

    def _css(self, text: str) -> Iterator[tuple[int, int, str]]:
        for m in _CSS_URL.finditer(text):
            k = m.lastindex
            if (new := self.reference(m[k])) != m[k]:
                yield m.start(k), m.end(k), new
        spans = [m.span() for m in _CSS_URL.finditer(text)]
        for a, b, new in self._tokens(text):
            if not any(x <= a < y for x, y in spans):
                yield a, b, new

    def _attribute(self, name: str, value: str) -> Iterator[tuple[int, int, str]]:
        """What moves in an attribute's value without references."""
        if name in URL_ATTRIBUTES:
            plain = value.strip()
            if plain and (new := self.reference(plain)) != plain:
                at = value.index(plain)
                yield at, at + len(plain), new
        elif name in SETS:
            for m in _CANDIDATE.finditer(value):
                if (new := self.reference(m[1])) != m[1]:
                    yield m.start(1), m.end(1), new
        elif name == "style":
            yield from self._css(value)
        elif parts_of(value):
            if (new := self.value(value)) != value:
                yield 0, len(value), new
        else:
            yield from self._tokens(value)

    def markup(self, text: str) -> str:
        """Block markup, edited in place: JSON of block comments by its leaves; attributes by what they hold; text, styles and other comments by their URLs.

        Character references are read, and what is put in place of text is written so that it means the same there.
        """
        edits: list[tuple[int, int, str]] = []

        def within(a: int, b: int, find: Callable[[str], Iterator[tuple[int, int, str]]], quote: bool) -> None:
            raw = text[a:b]
            if "&" not in raw:
                plain, at = raw, None
            else:
                plain, at = _decoded(raw)
            for x, y, new in find(plain):
                # What stays the same before and after stays as it is written.
                while x < y and new and plain[y - 1] == new[-1]:
                    y, new = y - 1, new[:-1]
                while x < y and new and plain[x] == new[0]:
                    x, new = x + 1, new[1:]
                if at is not None or quote:
                    new = html_lib.escape(new, quote=quote) if at is not None or any(c in new for c in "<>\"'") else new
                edits.append((a + at[x], a + at[y], new) if at is not None else (a + x, a + y, new))

        last, content = 0, None
        for start, end, name, closing, first, stop in markup_reader.tokens(text):
            if start > last:
                within(last, start, self._css if content == "style" else self._tokens, False)
            last, content = end, name if name in ("style", "script") and not closing else None
            if name == "!--":
                m = _COMMENT.fullmatch(text, start, end)
                if m and m[2]:
                    try:
                        new = json_edit(m[2], lambda s: self.value(s))
                    except ValueError:
                        continue
                    if new != m[2]:
                        edits.append((m.start(2), m.end(2), new))
                elif not m:
                    within(start, end, self._tokens, False)
            elif not closing and name != "!":
                for k, a, b in markup_reader.attributes(text, first, stop):
                    if a < b:
                        within(a, b, lambda v, k=k: self._attribute(k, v), True)
        within(last, len(text), self._css if content == "style" else self._tokens, False)
        return _edited(text, edits)

    def value(self, text: str, content: str | None = None, depth: int = 0) -> str:
        """A value of any format; ``content`` is block_markup, skip or nothing."""
        markup = content == "block_markup"
        if content == "skip" or not ("http" in text or markup) or not self.known(text, markup):
            return text
        if not depth:
            # Formats inside formats are followed as deep as they go; these are calls of Python's own, not of the C stack.
            old = sys.getrecursionlimit()
            sys.setrecursionlimit(max(old, 200_000))
            try:
                return self._value(text, content, depth)
            finally:
                sys.setrecursionlimit(old)
        return self._value(text, content, depth)

    def _value(self, text: str, content: str | None, depth: int) -> str:
        form = parts_of(text)
        if form:
            try:
                return form[1](text, lambda s: self.value(s, content, depth + 1))
            except (Malformed, ValueError):
                pass
        return self.markup(text) if content == "block_markup" else self.text(text)


def _edited(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with these places put anew; the same object where there are none."""
    out, last = [], 0
    for a, b, new in sorted(edits):
        if a >= last:
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]]) if out else text


def rewrite(value: Column, mapping: list[tuple[str, str]], content: str | None = None) -> Column:
    """Arrow UDF behind cheap guards: values without ``http`` or a mapped host never reach Python."""
    rewriter = Rewriter(mapping)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: rewriter.value(t, content), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    guard = F.contains(value, F.lit("http")) if content != "block_markup" else F.contains(value, F.lit("//")) | F.contains(value, F.lit("&"))
    if len(rewriter.hosts) <= 20 and content != "block_markup":
        guard = guard & F.rlike(F.lower(value), F.lit("|".join([*map(re.escape, sorted(rewriter.hosts)), r"\\u"]) or "(?!)"))
    return F.when(guard, F.pandas_udf(run, "string")(value)).otherwise(value)


# Where origins are looked for.
MEDIA_TAGS = ("img", "video", "audio", "source", "embed", "track", "object", "image")
MEDIA_BLOCKS = ("image", "cover", "gallery", "media-text", "video", "audio")
_MEDIA = re.compile(rf"<(?:{'|'.join(MEDIA_TAGS)})\b[^>]*>", re.I)


def origins_in(text: str | None) -> list[str]:
    """Origins of media tags, of media blocks, and of string values that are one whole URL, sorted."""
    found: set[str] = set()

    def add(url: str) -> None:
        if b := Base.of(url):
            found.add(f"{b.scheme}://{b.host}")

    for _, _, s in leaves(text):
        if _URL.fullmatch(s.strip()):
            add(s.strip())
            continue
        for tag in _MEDIA.findall(s):
            for m in _URL.findall(tag):
                add(m)
        for m in _COMMENT.finditer(s):
            if m[1] in MEDIA_BLOCKS and m[2]:
                for u in _URL.findall(m[2].replace("\\/", "/")):
                    add(u)
    return sorted(found)


def origins(value: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: origins_in(t) if isinstance(t, str) else [])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(value)


def string_leaves(value: Column) -> Column:
    """array of (path, ord, leaf): explode it for a row per string value."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"path": p, "ord": n, "leaf": v} for p, n, v in leaves(t)] if isinstance(t, str) else [])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<path:string,ord:int,leaf:string>>")(value)
