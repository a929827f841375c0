"""Cross-tokenizer alignment: a byte-level BPE (A) and a sentence-piece BPE (B) on the same text, joined where their tokens end together.

First pass: every document is encoded by both, cut into groups at the byte offsets where tokens of both end, and each group's last two
tokens are a link; each task counts its links by (A id, B id). Of two tokens that end together the bytes of one are the end of the
other's, so there are at most as many different pairs as tokens have endings that are tokens too: a bound that the vocabularies set
(under a million for two of 50,000), whatever the corpus. Over the pairs that occur a minimal perfect hash is built: keys alone in
their place of a bit table keep it, the others go to the next table, and a key's index is the number of set bits before its own. Counts
are then dense vectors indexed by the hash, summed over the tasks in a tree. Second pass: documents are encoded and aligned again and
look their links up; a key is verified against the table of keys, so an unknown pair counts nothing.

What is encoded: texts are cut where neither tokenizer can reach across, and a part that a worker has seen is not encoded again. A's
pre-tokens end with a run of letters or digits, and begin with the last space before something; B's merges never reach across two
characters that stand together in no piece.

Cases: texts that are null, empty or whose tokens' bytes are not those of space+text (B reads U+2581 as a space) have no tokens;
special strings are plain text; repeated rows count as often as they come; a null id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.llm.common import CHUNK_BYTES, giving_back, kept, lean, mix64, shared, table
from readloom.llm.pieces import code_points, cuts, processor, runs, slices
from readloom.llm.trees import SCHEMA, tree_summed

#: Parts, and characters of them, that a worker remembers (about 200 MB).
MEMORY, MEMORY_CHARS = 600_000, 16 << 20

#: Longs in a block of a dense vector.
BLOCK = 1 << 15


# ---------------------------------------------------------------- the two tokenizers


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def byte_level(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The tokenizer, and the number of bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    size = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():
        size[i] = len(token)  # a character a byte
    return t, size


@lru_cache(2)
def byte_strings(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte, t = _byte_of(), byte_level(path)[0]
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


@lru_cache(2)
def piece_strings(path: str) -> list[bytes]:
    """The bytes of each id of a sentence-piece vocabulary."""
    p = processor(path)
    return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]


# ---------------------------------------------------------------- places where both can be cut

_SPACE, _LETTER, _DIGIT, _MARK, _UNSURE = 1, 2, 3, 4, 5


@lru_cache(1)
def _kinds() -> np.ndarray:
    """White space of any script (unsure: what only some call so); letters, digits and marks up to U+024F, whose kinds are settled; else 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x250):
        x = chr(c)
        out[c] = _LETTER if x.isalpha() else _DIGIT if x.isdecimal() else _MARK if 0x20 < c < 0x7F else 0
    out[[c for c in range(0x3001) if chr(c).isspace()]] = _SPACE
    out[0x1C:0x20] = _UNSURE
    return out


def both_apart(points: np.ndarray, first: np.ndarray, b_path: str) -> np.ndarray:
    """Where a text can be cut for both tokenizers; `first` marks the texts' own beginnings."""
    kind = _kinds()[points]
    before = np.concatenate(([0], kind[:-1]))
    twice = np.concatenate(([0], before[:-1]))
    after = np.concatenate((kind[1:], [_SPACE]))
    after[:-1][first[1:]] = _SPACE  # the end of a text
    last = np.concatenate(([0], points[:-1]))
    blank, maybe = kind == _SPACE, (kind == _SPACE) | (kind == _UNSURE)
    a = (points == 0x20) & (after != _SPACE) & (after != _UNSURE)  # a space begins the next pre-token
    a |= (before == _LETTER) & (kind != _LETTER) & (points < 0x250)
    a |= (before == _DIGIT) & (blank | (kind == _LETTER) | (kind == _MARK))
    a |= (before == _MARK) & (blank | ((kind == _LETTER) & (last != 0x27)))
    # a single blank that is no space is a pre-token
    a |= (before == _SPACE) & (last != 0x20) & ~maybe & (twice != _SPACE) & (twice != _UNSURE) & ~np.concatenate(([False], first[:-1]))
    return (a & cuts(b_path).apart(points)) | first


# ---------------------------------------------------------------- aligned parts


class Parts:
    """What a worker knows of parts of texts, by a number of the part: the groups of tokens, as text, their links, and counts."""

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_size), self.b = byte_level(a_path), processor(b_path)
        self.b_path, self.a_bytes, self.b_bytes = b_path, byte_strings(a_path), piece_strings(b_path)
        self.b_size = np.array(list(map(len, self.b_bytes)))
        chars = {c for p in cuts(b_path).chars for c in p}
        self.guard = next(c for c in ("\n", *map(chr, range(0xE000, 0xF8FF))) if c not in chars)
        self.guarded = len(self.b.encode(self.guard))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: links of all parts one after the other, and by part: how many, tokens of A and of B, whether their bytes are the part's
        self.links, self.n_links, self.n_a, self.n_b, self.right = array("q"), array("i"), array("i"), array("i"), array("b")
        self.chars = 0

    @property
    def full(self) -> bool:
        return len(self.groups) > MEMORY or self.chars > MEMORY_CHARS

    def numbers(self, parts: list[str]) -> np.ndarray:
        number = self.number
        new = list(set(parts).difference(number))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            number.update(zip(some, range(len(self.groups), len(self.groups) + len(some))))
            self._add(some)
        return np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))

    def _add(self, parts: list[str]) -> None:
        """Encodes and aligns parts: where the ends of A's tokens and of B's meet is found for all of them together."""
        want = [x.encode() for x in parts]
        of_a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # a character that is in no piece stands between the library's own space and the part
        of_b = [x[self.guarded :] for x in self.b.encode([self.guard + x for x in parts], num_threads=1)]
        (a, a_part), (b, b_part) = ((np.array(list(chain.from_iterable(x)), np.int64), np.repeat(np.arange(len(parts)), list(map(len, x)))) for x in (of_a, of_b))
        right = np.ones(len(parts), bool)
        for ids, part, strings in ((a, a_part, self.a_bytes), (b, b_part, self.b_bytes)):
            pieces = [strings[i] for i in ids.tolist()]
            if b"".join(pieces) != b"".join(want):
                bounds = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
                right &= [b"".join(pieces[i:j]) == x for i, j, x in zip(bounds, bounds[1:], want)]
        a, a_part, b, b_part = a[right[a_part]], a_part[right[a_part]], b[right[b_part]], b_part[right[b_part]]
        # with the wrong parts gone both have the same bytes, one after the other
        _, i, j = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
        last_a, last_b = a[i], b[j]
        groups = [f"{x}|{y}" for x, y in zip(last_a.tolist(), last_b.tolist())]
        from_a, from_b = np.concatenate(([0], i + 1))[: len(i)], np.concatenate(([0], j + 1))[: len(j)]
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        more = np.flatnonzero((i > from_a) | (j > from_b))
        for k, a0, a1, b0, b1 in zip(*(x.tolist() for x in (more, from_a[more], i[more] + 1, from_b[more], j[more] + 1))):
            groups[k] = f"{','.join(text_a[a0:a1])}|{','.join(text_b[b0:b1])}"
        bounds = np.searchsorted(a_part[i], np.arange(len(parts) + 1))
        self.groups += [";".join(groups[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
        self.links.frombytes((last_a << 32 | last_b).tobytes())
        for column, values in ((self.n_links, np.diff(bounds)), (self.n_a, np.bincount(a_part, minlength=len(parts))), (self.n_b, np.bincount(b_part, minlength=len(parts)))):
            column.frombytes(values.astype(np.int32).tobytes())
        self.right.frombytes(right.astype(np.int8).tobytes())
        self.chars += sum(map(len, parts))

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bounds, numbers of parts) of runs of texts: text k of a run has the parts from bounds[k] to bounds[k + 1]."""
        for first, last in runs([t or "" for t in texts], CHUNK_BYTES):
            some = [" " + t if t else "" for t in texts[first:last]]
            joined = "".join(some)
            begin = np.cumsum([0, *map(len, some)])
            if not joined:
                yield first, begin, np.zeros(0, np.int64)
                continue
            own = np.zeros(len(joined), bool)
            own[begin[:-1][begin[:-1] < len(joined)]] = True
            at = np.flatnonzero(both_apart(code_points(joined), own, self.b_path))
            yield first, np.searchsorted(at, begin), self.numbers(slices(joined, at))


@lru_cache(1)
def known_parts(a_path: str, b_path: str) -> Parts:
    return Parts(a_path, b_path)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


# ---------------------------------------------------------------- first pass: pairs and their counts


class PairHash:
    """A minimal perfect hash of distinct keys, and the table of keys that verifies them."""

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        keys = np.unique(np.asarray(keys, np.uint64))
        left, words, self.levels, at = keys, [], [], 0
        while len(left):
            size = -(-int(room * len(left) + 64) // 64) * 64
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            self.levels.append((at, size))
            at += size // 64
            left = left[~alone]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._index(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (first, size) in enumerate(self.levels):
            place = self._place(keys[todo], level, size)
            word, bit = first + place // 64, (place % 64).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[found]] = (self.before[word] + np.bitwise_count(below))[found]
            todo = todo[~found]
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that the hash was not made of."""
        keys = np.asarray(keys).astype(np.uint64)
        out = self._index(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): each task's links, counted by pair (A id times 2**32, plus B id)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses = known_parts(a_path, b_path), np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            times = np.repeat(uses, np.array(known.n_links[: len(uses)], np.int64))
            pair, at = np.unique(np.array(known.links[: len(times)], np.int64)[times > 0], return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, times[times > 0])
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for b in batches:
            for _, bounds, numbers in known.of(b.column(0).to_pylist()):
                whole = _sums(np.array(known.right, np.int8)[numbers] == 0, bounds) == 0
                uses = np.concatenate((uses, np.zeros(len(known.groups) - len(uses), np.int64)))
                uses += np.bincount(numbers[np.repeat(whole, np.diff(bounds))], minlength=len(uses))
                if known.full:
                    yield counted()
                    known.forget()
                    uses = uses[:0]
        yield counted()

    return docs.select("text").mapInArrow(run, "pair long, n long")


class LinkTable:
    """Counts of all pairs that the corpus has, by the minimal perfect hash; whether a pair's is the highest of its B id."""

    def __init__(self, pairs: PairHash, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        b = (pairs.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
        np.maximum.at(highest, b, counts)
        self.best = counts == highest[b]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.pairs.index(keys)
        if not len(self.counts):
            return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        return np.where(at >= 0, self.counts[at], 0), (at >= 0) & self.best[at]


def link_table(docs: DataFrame, a_path: str, b_path: str) -> LinkTable:
    """The links of all documents, counted. The driver sees each different pair once, of which the vocabularies allow a bounded number."""
    spark = docs.sparkSession
    with giving_back(spark):
        rows = kept(link_counts(docs, a_path, b_path), "link-counts")
        pairs = PairHash(rows.select("pair").distinct().toArrow().column("pair").to_numpy())
        value = shared(spark, pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense = np.zeros(-(-len(value.value.keys) // BLOCK) * BLOCK, np.int64)
            for b in batches:
                np.add.at(dense, value.value.index(b.column(0).to_numpy()), b.column(1).to_numpy())
            blocks = [i for i in range(len(dense) // BLOCK) if dense[i * BLOCK : (i + 1) * BLOCK].any()]
            sums = [dense[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], ["part", "block", "sums"])

        partials = rows.mapInArrow(run, SCHEMA).withColumn("part", F.spark_partition_id())
        counts = np.zeros(-(-len(pairs.keys) // BLOCK) * BLOCK, np.int64)
        for r in tree_summed(partials, "i8").collect():
            counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64)
    return LinkTable(pairs, counts[: len(pairs.keys)])


# ---------------------------------------------------------------- second pass


def aligned(docs: DataFrame, table: LinkTable, a_path: str, b_path: str) -> DataFrame:
    """Rows of `docs` as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), groups as `a1,a2|b1;a3|b2,b3`."""
    value = shared(docs.sparkSession, table)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_parts = known_parts(a_path, b_path), np.zeros((0, 6), np.int64)  # whether wrong, tokens of A, of B, links, best links, sum of counts
        for b in batches:
            for first, bounds, numbers in known.of(b.column(1).to_pylist()):
                done = len(of_parts)
                if done < len(known.groups):
                    new = np.zeros((len(known.groups) - done, 6), np.int64)
                    n_links = np.array(known.n_links[done:], np.int64)
                    ends = np.concatenate(([0], np.cumsum(n_links)))
                    counts, best = value.value.look_up(np.array(known.links[len(known.links) - ends[-1] :], np.int64))
                    new[:, 0], new[:, 1], new[:, 2] = np.array(known.right[done:], np.int64) == 0, known.n_a[done:], known.n_b[done:]
                    new[:, 3], new[:, 4], new[:, 5] = n_links, _sums(best, ends), _sums(counts, ends)
                    of_parts = np.concatenate((of_parts, new))
                found = np.stack([_sums(of_parts[numbers, k], bounds) for k in range(6)])
                found[:, found[0] > 0] = 0
                n, groups = len(bounds) - 1, known.groups
                texts = [";".join([groups[x] for x in numbers[i:j].tolist()]) if whole else "" for i, j, whole in zip(bounds, bounds[1:], found[1] > 0)]
                columns = [b.column(0).slice(first, n), *map(pa.array, (found[1], found[2], found[3], found[3], found[4], found[5])), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
                if known.full:
                    known.forget()
                    of_parts = of_parts[:0]

    rows = docs.select("doc_id", "text")
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", *[zero.alias(c) for c in names[1:7]], F.lit("").alias("groups")).schema
    return rows.mapInArrow(run, schema)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = aligned(docs, link_table(docs, *paths), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)
