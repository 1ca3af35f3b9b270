"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark of its beginning; its best segmentation under a unigram model
(the largest sum of piece scores) gives its tokens. The distinct pre-tokens of a batch form a trie,
walked in order: the forward scores of a prefix, and the token count of the best way to it, are
computed once for all words that share it and are kept along the path; a word's count is stored
at its end. Characters that no piece covers cost one token per UTF-8 byte.

Defined cases: null and empty texts have no tokens; repeated rows each get their row; extra columns
are ignored; whole texts are counted. Among equal scores fewer tokens win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Score of a byte token; below all pieces.
BYTE = -25.0
KNOWN_WORDS = 500_000


def unigram(path: str = MODEL) -> dict[str, float]:
    """Piece scores from a vocabulary file: log-probabilities by Zipf's law over the pieces' ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(own, key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)}


def backward(pieces: dict[str, float]) -> dict[str, float | None]:
    """Every ending of a piece, with the score where it is a piece: looking back stops at what is no ending."""
    out: dict[str, float | None] = {}
    for p in pieces:
        for i in range(len(p)):
            out.setdefault(p[i:], None)
    return out | pieces


def count_words(words: list[str], endings: dict[str, float | None]) -> dict[str, int]:
    """Tokens of each distinct pre-token, by ``backward`` of the pieces."""
    out: dict[str, int] = {}
    # Along the path from the trie's root: best score and its tokens by depth.
    score, tokens, path = [0.0], [0], ""
    get = endings.get
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            n = len(word[d - 1].encode("utf-8", "replace"))
            best, count = score[d - 1] + BYTE * n, tokens[d - 1] + n
            for j in range(d - 1, -1, -1):
                s = get(word[j:d], False)
                if s is False:
                    break
                if s is not None:
                    s += score[j]
                    if s > best or s == best and tokens[j] + 1 < count:
                        best, count = s, tokens[j] + 1
            score.append(best)
            tokens.append(count)
        path = word
        out[word] = tokens[-1]
    return out


def counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document. The piece table (its size is the vocabulary's) is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(backward(unigram(path)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        endings = sent.value
        known: dict[str, int] = {}
        for x in parts:
            split = [[MARK + w for w in (t or "").split()] for t in x.text]
            new = {w for ws in split for w in ws if w not in known}
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = {w for ws in split for w in ws}
            known.update(count_words(list(new), endings))
            yield pd.DataFrame({"doc_id": x.doc_id, "n_pretokens": [len(ws) for ws in split], "n_tokens": [sum(map(known.__getitem__, ws)) for ws in split]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
