"""HTML read once from start to end: tags with the places of their attributes; nothing is read twice, whatever is left open.

Places are offsets into the text, so a caller can edit a value and leave every other character as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)|[!?])")
_TAIL = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s>"'][^\s>]*+))?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
#: Elements whose content is text up to their end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

Token = tuple[int, int, str, bool, int, int]


def tokens(s: str, raw: tuple[str, ...] = RAW) -> Iterator[Token]:
    """(start, end, name, closing, first and last place of the attributes) of every tag; comments are named ``!--``, declarations ``!``.

    What lies between is text; after the tag of a ``raw`` element it is that element's content. A comment or such an
    element without an end goes on to the end of the text. Where the quotes of a tag swallow the last ``>``, tags end at their next ``>`` from
    there on; a tag without any is text.
    """
    at, last = 0, s.rfind(">")
    quotes = True
    while m := _OPEN.search(s, at):
        start = m.start()
        name = m[2]
        if name is None:
            if s.startswith("<!--", start):
                end = s.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(s)
                yield start, at, "!--", False, start + 4, end if end >= 0 else at
                continue
            if start > last:
                return
            at = s.index(">", start) + 1
            yield start, at, "!", False, start + 2, at - 1
            continue
        if start > last:
            return
        tail = _TAIL.match(s, m.end()) if quotes else None
        if tail is None:
            quotes = False
            if (close := s.find(">", m.end())) < 0:
                return
            at = close + 1
        else:
            at = tail.end()
        name = name.lower()
        yield start, at, name, bool(m[1]), m.end(), at - 1
        if name in raw and not m[1]:
            end = _END[name].search(s, at)
            at = end.start() if end else len(s)


def attributes(s: str, first: int, last: int) -> Iterator[tuple[str, int, int]]:
    """(name, first and last place of the value) of the attributes in that part of a tag; one without a value has an empty place."""
    for m in _ATTRIBUTE.finditer(s, first, last):
        group = m.lastindex if m.lastindex and m.lastindex > 1 else 0
        a, b = m.span(group) if group else (m.end(), m.end())
        yield m[1].lower(), a, b
