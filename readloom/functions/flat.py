"""Read features of a whole Arrow batch as flat numpy arrays, for kernels that walk all of them at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a string array; a null is empty."""
    a = pc.fill_null(a.cast(pa.large_binary()), b"")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _ended(data: np.ndarray) -> np.ndarray:
    """The bytes and a zero, for places at their end."""
    return np.append(data, np.uint8(0))


def numbers(a: pa.Array, null: int = 0) -> np.ndarray:
    return a.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of `source` one after the other."""
    ends = np.cumsum(lengths)
    return source[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def offsets_of(a: pa.Array) -> np.ndarray:
    """Bounds of a list array's items in its flattened values; nulls have none."""
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def letters(a: pa.Array) -> np.ndarray:
    """First byte of each string, 0 where there is none."""
    data, at, length = spans(a)
    return np.where(length > 0, _ended(data)[at], 0).astype(np.uint8)


def strings(data: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string array from its bytes and lengths; null where not valid."""
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    if bounds[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.string(), len(lengths), [bits, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [bits, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def upper(data: np.ndarray) -> np.ndarray:
    return _UPPER[data]


class Positional:
    """Features that stand at a position of their read: all but the quality features q and Q.

    `first[r]` to `first[r + 1]` are read r's; `code` is a byte, `before` is where the reference stands before the feature.
    """

    def __init__(self, features: pa.Array, start: pa.Array):
        x = features.flatten()
        bounds = offsets_of(features)
        code = letters(x.field("code"))
        stays = np.flatnonzero((code != 0) & ~self._in(code, "qQ"))
        self.struct, self.code = x.take(pa.array(stays)), code[stays]
        self.first = np.searchsorted(stays, bounds)
        self.n_reads = len(features)
        self.read = np.repeat(np.arange(self.n_reads), np.diff(self.first))
        self.ref_pos, self.num = numbers(self.struct.field("ref_pos")), numbers(self.struct.field("num"))
        advance = np.where(self.is_("XB"), 1, np.where(self.is_("bDN"), self.num, 0))
        #: where the reference stands after a feature
        self.after = self.ref_pos + advance
        self.start = numbers(start, (1 << 31) - 1)
        self.before = np.concatenate(([0], self.after[:-1]))[: len(self.code)]
        heads = self.first[:-1][np.diff(self.first) > 0]
        self.before[heads] = self.start[self.read[heads]]
        #: where it stands after a read's last feature
        self.last = self.start.copy()
        some = np.diff(self.first) > 0
        self.last[some] = self.after[self.first[1:][some] - 1]

    @staticmethod
    def _in(code: np.ndarray, letters: str) -> np.ndarray:
        return np.isin(code, np.frombuffer(letters.encode(), np.uint8))

    def is_(self, letters: str) -> np.ndarray:
        return self._in(self.code, letters)

    def interleaved(self, gaps: np.ndarray, own: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """For each read: the gap before and the own value of every feature in turn, then its tail."""
        out = np.empty(2 * len(self.code) + self.n_reads, gaps.dtype)
        at = 2 * np.arange(len(self.code)) + self.read
        out[at], out[at + 1] = gaps, own
        out[2 * self.first[1:] + np.arange(self.n_reads)] = tails
        return out
