"""Cost-balanced packing of documents into sequences of at most 1024 tokens.

The cost of a piece is estimated as a linear part plus a quadratic one, the attention within it.
A document's whole stretches of a sequence's length are sequences of their own. What is left of each
is packed: in descending order of cost a rest goes to the sequence of lowest cost with room for it,
and a rest that no sequence can hold whole is cut, each cut going to the sequence of lowest cost
with room for ``PIECE`` tokens. A group of rests opens as many sequences as its tokens fill. What is over goes into
further ones and, as sequences whose length is a power of two need no padding, into one of
each power of two in the binary form of the last tokens: only gaps of under ``PIECE`` tokens are padded.

Rests are dealt by a hash into groups of some ``GROUP`` rows, each packed in a task of its own with heaps by
room and cost; cut freely and balanced alike, groups need not know of one another. Tokens of a word
are looked up once for many words: a byte-level vocabulary never joins across a blank before a
letter, digit or sign.

Defined cases: a null or empty text has the end token only; repeated rows and null ids are documents
of their own; an empty table gives no rows; extra columns are ignored; whole texts of any length are cut.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

LENGTH = 1024
END = 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (width of the layers over that of the attention).
LINEAR, QUADRATIC = 4096.0, 1.0
#: Fewest tokens of a cut, but for the last of a rest.
PIECE = 8
#: Rests of a group, on average.
GROUP = 5_000
#: Distinct words whose tokens a worker keeps; the words of a hundred texts more.
KNOWN_WORDS = 500_000
SPECIAL = "<|endoftext|>"
# Fixed value: how a byte-level vocabulary cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?= [\w!-~])")
_ODD = re.compile(r" (?![\w!-~])")
#: ASCII and Latin letters, which every version of Unicode in use holds to be letters.
_LATIN = re.compile("[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]*")
#: Tokenizers of this worker, with the tokens of the words that it has met.
_ready: dict[str, Callable[[list[str]], list[bytes]]] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(text: str) -> list[str]:
    """Stretches of the text that are tokenized alone: cuts are before a blank that a plain character follows."""
    if SPECIAL in text:
        return [text]
    out = _CUT.split(text)
    return out if out[0] else out[1:]


def cut(text: str) -> tuple[str, list[str]]:
    """The start of a text up to its first cut, and the words from each cut on without their blank."""
    if SPECIAL in text:
        return text, []
    # Where a plain character follows each blank, cuts are at all blanks, which is faster to tell than to look ahead at every place.
    if not _ODD.search(text):
        words = text.split(" ")
        return words.pop(0), words
    first, *words = _CUT.split(text)
    return first, [w[1:] for w in words]


def ascii_encoder(path: str, t) -> Callable[[str], list[int]] | None:
    """A faster encoder of ASCII text and Latin letters for the same vocabulary, where it is sure to give the same ids: byte-level merges whose ids are in their order.

    A pair is then merged by the id of what it makes, which is what the other library looks for. Beyond these characters the two may tell letters and space apart otherwise.
    """
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path) as f:
        data = json.load(f)
    before, model = data["pre_tokenizer"] or {}, data["model"]
    vocab, merges = model["vocab"], model.get("merges") or []
    if (before.get("type"), before.get("use_regex"), before.get("add_prefix_space"), data["normalizer"], model["type"]) != ("ByteLevel", True, False, None, "BPE"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab["".join(m)] != 256 + i for i, m in enumerate(pairs)):
        return None
    # What stands for each byte: a text of all of them is written by the pre-tokenizer itself.
    letters = {c: b for b in range(128) for c in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]}
    rest = iter(range(128, 256))
    shown = sorted(set(ByteLevel.alphabet()) - set(letters))
    kept = {c: ord(c) for c in shown if 161 <= ord(c) <= 172 or 174 <= ord(c) <= 255}
    left = [b for b in rest if b not in kept.values()]
    letters |= kept | dict(zip([c for c in shown if c not in kept], left, strict=True))
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs) and set(token) <= letters.keys()}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts -> their ids, each as little-endian unsigned 32-bit. A worker's later tasks find it made, with the words it knows."""
    if path in _ready:
        return _ready[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_file(path)
    # Bytes of each token: a token is written with a character for each byte, but for the special one.
    alphabet = set(ByteLevel.alphabet())
    size = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():
        size[i] = len(token) if alphabet.issuperset(token) and token != SPECIAL else len(token.encode())
    # By word, without the blank before it.
    known: dict[str, bytes] = {}
    plain = ascii_encoder(path, t)

    def learn(words: list[str], fast: bool) -> None:
        """One text of many words, each with its blank, has the tokens of each word one after another."""
        text = " " + " ".join(words)
        ids = np.asarray(plain(text) if fast else t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        lengths = np.fromiter(map(len, words if text.isascii() else map(str.encode, words)), np.int64, len(words)) + 1
        ends = (4 * (np.searchsorted(np.cumsum(size[ids]), np.cumsum(lengths)) + 1)).tolist()
        known.update(zip(words, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def run(texts: list[str]) -> list[bytes]:
        firsts, words = zip(*map(cut, texts), strict=True)
        new = set().union(*words).difference(known)
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = set().union(*words)
        ascii_words, latin, others = [], [], []
        for w in new:
            (ascii_words if w.isascii() else latin if _LATIN.fullmatch(w) else others).append(w)
        for some, fast in ((ascii_words, plain is not None), (latin, plain is not None), (others, False)):
            for at in range(0, len(some), 1000):
                learn(some[at : at + 1000], fast)
        # What a text begins with lacks a blank or is a whole text with the special token: no word.
        starts = [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(list(firsts), add_special_tokens=False)]
        return [s + (b"".join(itemgetter(*w)(known)) if len(w) > 1 else b"".join(known[x] for x in w)) for s, w in zip(starts, words, strict=True)]

    return _ready.setdefault(path, run)


class Sequences:
    """Sequences under construction, in a heap of costs for each number of tokens left; ``powers`` adds those for the tokens beyond whole ones."""

    def __init__(self, tokens: int, length: int = LENGTH, powers: bool = False):
        whole, rest = divmod(tokens, length)
        room = [length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if powers and rest >> b & 1]
        self.size, self.used = room, [0] * len(room)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.lowest = np.full(length + 1, np.inf)
        for k, r in enumerate(room):
            self._push(r, 0.0, k)

    def _push(self, room: int, cost: float, k: int) -> None:
        heapq.heappush(self.heaps[room], (cost, k))
        self.lowest[room] = self.heaps[room][0][0]

    def place(self, n: int, least: int) -> tuple[int, int, int] | None:
        """Put up to ``n`` tokens where the cost is lowest among sequences with room for ``least``: sequence, offset, tokens put."""
        room = least + int(self.lowest[least:].argmin())
        if not self.heaps[room]:
            return None
        cost, k = heapq.heappop(self.heaps[room])
        self.lowest[room] = self.heaps[room][0][0] if self.heaps[room] else np.inf
        put, at = min(n, room), self.used[k]
        self.used[k] += put
        if room > put:
            self._push(room - put, cost + LINEAR * put + QUADRATIC * put * put, k)
        return k, at, put


def assign(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(row, start in it, tokens, sequence, offset) of the pieces of rests of these lengths."""
    held = Sequences(int(lengths.sum()), length)
    out, over = [], []
    for row in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[row])
        if (got := held.place(n, n)) is None:
            over.append((row, 0, n))
        else:
            out.append((row, 0, got[2], got[0], got[1]))

    def cut(over: list[tuple[int, int, int]], held: Sequences, least: int, first: int) -> list[tuple[int, int, int]]:
        """Fill the gaps; what they do not hold."""
        left = []
        for row, start, n in over:
            while n and (got := held.place(n, min(n, least))):
                k, at, put = got
                out.append((row, start, put, first + k, at))
                start, n = start + put, n - put
            if n:
                left.append((row, start, n))
        return left

    left = cut(over, held, PIECE, 0)
    cut(left, Sequences(sum(n for _, _, n in left), length, powers=True), 1, len(held.size))
    return out


def tokenized(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """n (a number of the piece), doc_id, start, ids, doc_tokens: whole stretches of ``length`` tokens, and the rest of every document."""
    path = path or vocabulary()
    small_batches(docs.sparkSession, 500)
    end = np.asarray([END], "<u4").tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of, n, step = tokenizer(path), TaskContext.get().partitionId() << 33, 4 * length
        for x in parts:
            # Some texts at a time, so pieces of a batch stay small beside it.
            for at in range(0, len(x), 100):
                texts = x.text.iloc[at : at + 100]
                rows = []
                for doc, b in zip(x.doc_id.iloc[at : at + 100], ids_of([t or "" for t in texts]), strict=True):
                    b += end
                    for s in range(0, len(b), step):
                        rows.append((n, doc, s // 4, b[s : s + step], len(b) // 4))
                        n += 1
                yield pd.DataFrame(rows, columns=["n", "doc_id", "start", "ids", "doc_tokens"])

    # Ids travel as text: pandas has no nullable whole numbers here.
    pieces = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return pieces.mapInPandas(run, "n long, doc_id string, start long, ids binary, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    Sequences of one whole stretch have even numbers, packed ones odd numbers.
    """
    pieces = staged(tokenized(docs, path, length), "pack-pieces")
    size = (F.octet_length("ids") / 4).cast("long")
    columns = [F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.where(size == length).select(
        "doc_id", "start", size.alias("length"), "ids", "doc_tokens", (F.col("n") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rests = pieces.where(size < length)
    groups = max(1, -(-rests.count() // GROUP))
    rests = rests.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups)))

    def fill(x: pd.DataFrame) -> pd.DataFrame:
        # Rows of a group come in any order: their numbers set it.
        x = x.sort_values("n", ignore_index=True)
        lengths = (x.ids.str.len() // 4).to_numpy()
        got = np.array(assign(lengths, length), np.int64).reshape(-1, 5)
        row, start, put, k, at = got.T
        ids = [x.ids.iat[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), put.tolist())]
        return pd.DataFrame(
            {"doc_id": x.doc_id.to_numpy()[row], "start": x.start.to_numpy()[row] + start, "length": put, "ids": ids, "doc_tokens": x.doc_tokens.to_numpy()[row],
             "sequence_id": (((int(x.g.iat[0]) << 32) + k) << 1) + 1, "offset": at}
        )

    schema = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    packed = rests.groupBy("g").applyInPandas(fill, schema)
    return whole.select(columns).unionByName(packed.select(columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and cost of every packed sequence."""
    cost = LINEAR * F.col("length") + QUADRATIC * F.col("length") * F.col("length")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces"), F.sum(cost).alias("cost"))
