"""Sentence-piece vocabularies: pieces with their ranks, and where a text can be cut without changing its merges.

Two neighbouring characters that stand side by side in no piece never end up in one token, so merges on either side of them do not
meet: `Cuts` finds these places in many texts at once, and what lies between is worked on once for each different string.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import sentencepiece

SPACE = "▁"


@lru_cache(4)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def ranks(path: str) -> dict[str, int]:
    """Rank of each piece that merges can make, from 0, equal scores sharing one; bytes, control and unknown pieces are none."""
    p = processor(path)
    scores = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))}
    order = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
    return {piece: order[score] for piece, score in scores.items()}


class Cuts:
    """Places of a text where no piece of a vocabulary can reach across."""

    def __init__(self, pieces):
        chars = sorted({c for p in pieces for c in p})
        self.chars = frozenset(c for c in pieces if len(c) == 1)
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.number[0x20] = self.number[ord(SPACE)]
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in pieces:
            at = self.number[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True

    def apart(self, points: np.ndarray) -> np.ndarray:
        """For each code point, whether no piece joins it to the one before; the first is apart."""
        out = np.ones(len(points), bool)
        at = self.number[points]
        out[1:] = ~self.joined[at[:-1], at[1:]]
        return out


@lru_cache(4)
def cuts(path: str) -> Cuts:
    return Cuts(ranks(path))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(text: str, starts: np.ndarray) -> list[str]:
    bounds = [*starts.tolist(), len(text)]
    return [text[i:j] for i, j in zip(bounds, bounds[1:])]


def runs(texts: list[str], limit: int = 1 << 20):
    """(first, last + 1) of runs of whole texts with about `limit` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
