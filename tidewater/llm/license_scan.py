"""License scans: fuzzy search for short notices.

A text is taken as its words, joined by single spaces. A phrase that may differ in k edits is cut
into k + 1 pieces; by the pigeonhole principle one piece stands unchanged in every match, so exact
hits of pieces locate the candidates. Windows around them go to the regex library's bounded-error
matching, which verifies the edits and reports the span. Exact places are counted from the same
words.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows each get
their row; extra columns are ignored; whole texts are read and every place is counted.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import small_batches

# Phrases, their labels, and the edits a match may have. In the shortest phrase a
# changed letter names another license, so there only missing and added characters are allowed.
PHRASES = (
    ("under the mit license", "mit", 2, "e<=2"),
    ("apache license version 2", "apache-2", 2, "e<=2"),
    ("cc by nc", "cc-by-nc", 1, "s<=0,i<=1,d<=1,e<=1"),
)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The phrase in ``edits`` + 1 parts, with their places."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


_PLAN = [
    (p.encode(), len(p.split()), label, k, pieces(p.encode(), k), regex.compile(f"(?:{p}){{{limit}}}".encode(), regex.BESTMATCH))
    for p, label, k, limit in PHRASES
]


def near(line: bytes, a: int, b: int, length: int, k: int, pattern: regex.Pattern) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the runs of whole words of a window that the pattern matches, none over another: fewest edits first, then the leftmost.

    Each run of about the phrase's length is matched whole: a search may pass over one whose last word is missing.
    """
    cuts = [i for i in range(a, min(b, len(line))) if line[i] == 32]
    runs = ((s + 1, e) for n, s in enumerate(cuts) for e in itertools.takewhile(lambda e: e - s - 1 <= length + k, cuts[n + 1 : n + 2 + length + k]) if e - s - 1 >= length - k)
    matches = sorted((sum(m.fuzzy_counts), s, e) for s, e in runs if (m := pattern.fullmatch(line, s, e)))
    kept: list[tuple[int, int, int]] = []
    for m in matches:
        at = bisect.bisect_left(kept, m[1], key=lambda x: x[1])
        if (at == 0 or kept[at - 1][2] < m[1]) and (at == len(kept) or m[2] < kept[at][1]):
            kept.insert(at, m)
    return kept


def scan(text: str | None) -> tuple[int, list[tuple[int, int, str, int]]]:
    """Number of words, and matches as (first word, last word, label, edits), exact ones with 0 edits."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    starts: list[int] | None = None
    found = []

    def word_at(place: int) -> int:
        nonlocal starts
        if starts is None:
            starts = (np.cumsum([1, *(len(w) + 1 for w in words)])).tolist()
        return bisect.bisect_right(starts, place) - 1

    for phrase, n, label, k, parts, pattern in _PLAN:
        exact, at = [], line.find(b" " + phrase + b" ")
        while at >= 0:
            exact.append(at + 1)
            at = line.find(b" " + phrase + b" ", at + 1)
        found += [(w := word_at(a), w + n - 1, label, 0) for a in exact]
        # Windows in which a match with a piece at that place lies; overlapping ones are one.
        spans = []
        for offset, piece in parts:
            at = line.find(piece)
            while at >= 0:
                spans.append((max(0, at - offset - k - 1), at - offset + len(phrase) + k + 1))
                at = line.find(piece, at + 1)
        if len(spans) == len(exact) * len(parts):
            continue  # all pieces are those of exact places
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            found += [(word_at(s), word_at(e - 1), label, edits) for edits, s, e in near(line, a, b, len(phrase), k, pattern) if edits]
    return len(words), sorted(found)


def _summary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    length = {label: len(p) for p, label, *_ in PHRASES}
    for x in parts:
        rows = []
        for doc_id, text in zip(x.doc_id, x.text, strict=True):
            n, found = scan(text)
            base = [f for f in found if f[3] == 0]
            firsts = [f[0] for f in base]
            names = lambda fs: ",".join(sorted({f[2] for f in fs}))
            score = max((1 - f[3] / length[f[2]] for f in found), default=0.0)
            spans = [f"{a}-{b}:{label}:{edits}" for a, b, label, edits in found if edits]
            rows.append((doc_id, n, len(base), min(firsts, default=None), max(firsts, default=None), names(base), names(found), score, spans))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "fuzzy_spans"])
        yield out.astype({"first_word": "Int64", "last_word": "Int64", "doc_id": "Int64"})


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: counts, labels, score, and the spans of fuzzy matches."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(
        _summary,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fuzzy_spans array<string>",
    )
