"""Read bases and differences from the reference, from read features and a stretch of reference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.cigar import FEATURES
from readloom.functions.flags import _listed
from readloom.functions.flat import Positional, gathered, letters, numbers, offsets_of, spans, strings, upper

MISMATCH = T.StructType([T.StructField("code", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("ref_pos", "length")], T.StructField("bases", T.StringType()), T.StructField("qual", T.IntegerType()), T.StructField("ref_base", T.StringType()), T.StructField("clip_length", T.IntegerType())])


def _cut(ref: Column, ref_start: Column, begin: Column, end: Column) -> Column:
    """Reference bases [begin, end) from a stretch that begins at ref_start; empty where end is not above begin. Bytes are found without a walk."""
    return F.substring(ref.cast("binary"), begin - ref_start + 1, F.greatest(F.lit(0), end - begin)).cast("string")


@F.arrow_udf(T.StringType())
def _bases(features: pa.Array, start: pa.Array, read_length: pa.Array, ref: pa.Array, ref_start: pa.Array) -> pa.Array:
    """All reads of a batch at once: pieces of reference and of features, in order, from one buffer of bytes."""
    f = Positional(features, start)
    sub = f.struct.field("sub").fill_null("N")
    known = pc.and_(pc.is_valid(ref), pc.and_(pc.is_valid(start), pc.is_valid(read_length))).to_numpy(zero_copy_only=False)
    parts = [spans(x) for x in (ref, f.struct.field("payload"), sub)]
    source = np.concatenate([p[0] for p in parts])
    (_, ref_at, ref_len), (_, own_at, own_len), (_, sub_at, sub_len) = parts
    own_at, sub_at = own_at + len(parts[0][0]), sub_at + len(parts[0][0]) + len(parts[1][0])
    of_sub, of_own = f.is_("X"), f.is_("BbIiS")
    low = numbers(ref_start)

    def piece(read: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, e = (np.clip(x - low[read], 0, ref_len[read]) for x in (begin, end))
        return ref_at[read] + b, np.where(known[read], np.maximum(0, e - b), 0)

    gap_at, gap_len = piece(f.read, f.before, f.ref_pos)
    own_len = np.where(known[f.read], np.where(of_sub, sub_len, np.where(of_own, own_len, 0)), 0)
    sums = np.concatenate(([0], np.cumsum(gap_len + own_len)))
    wanted = np.where(known, numbers(read_length), 0)
    body = sums[f.first[1:]] - sums[f.first[:-1]]
    tail_at, tail_len = piece(np.arange(f.n_reads), f.last, f.last + wanted - body)
    if (body + tail_len != wanted).any():
        raise ValueError("read features do not add up to the read's length")
    starts = f.interleaved(gap_at, np.where(of_sub, sub_at, own_at), tail_at)
    bases = upper(gathered(source, starts, f.interleaved(gap_len, own_len, tail_len)))
    offsets = np.concatenate(([0], np.cumsum(wanted))).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_binary(), f.n_reads, [None, pa.py_buffer(offsets), pa.py_buffer(bases)]).cast(pa.large_string())
    return pc.if_else(pa.array(known), text, pa.scalar(None, pa.large_string())).cast(pa.string())


def read_bases(features: Column, start: Column, read_length: Column, ref: Column, ref_start: Column, unknown: Column | None = None) -> Column:
    """Upper-case bases of a mapped read; null if `unknown`, or without reference, start or length; features that contradict the length raise.

    Only the stretch of reference that a read can lie on is handed to the kernel.
    """
    last = F.try_element_at(features, F.lit(-1))
    wide = F.greatest(F.lit(0), F.coalesce(last["ref_pos"] + F.coalesce(last["num"], F.lit(0)) - start, F.lit(0))) + F.greatest(F.lit(0), read_length) + 1
    begin = F.greatest(start, ref_start)
    cut = F.when(ref.isNotNull() & (~unknown if unknown is not None else F.lit(True)), _cut(ref, ref_start, begin, start + wide))
    return _bases(_listed(features, FEATURES), start.cast("int"), read_length.cast("int"), cut, begin.cast("int"))


@F.arrow_udf(T.ArrayType(MISMATCH))
def _differences(features: pa.Array, ref: pa.Array, ref_start: pa.Array, quals: pa.Array, low: pa.Array, high: pa.Array, origin: pa.Array) -> pa.Array:
    """All reads of a batch at once: one record a feature, a run of single-base insertions, or a differing base of a stored stretch."""
    f = Positional(features, pa.nulls(len(features), pa.int32()))
    (ref_data, ref_at, ref_len), from_, lo, hi = spans(ref), numbers(ref_start), numbers(low), numbers(high)
    q_data, q_first, q_len = numbers(quals.flatten(), -1), offsets_of(quals)[:-1], np.diff(offsets_of(quals))
    own_data, own_at, own_len = spans(f.struct.field("payload"))
    pos, place, read = numbers(f.struct.field("pos")), np.arange(len(f.code)), f.read

    def reference(read: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The reference's letter there, 0 where it is not known."""
        i = at - from_[read]
        inside = (i >= 0) & (i < ref_len[read])
        return np.where(inside, upper(np.append(ref_data, np.uint8(0))[np.where(inside, ref_at[read] + i, -1)]), 0).astype(np.uint8)

    def quality(read: np.ndarray, pos: np.ndarray) -> np.ndarray:
        inside = (pos >= 0) & (pos < q_len[read])
        return np.where(inside, np.append(q_data, -1)[np.where(inside, q_first[read] + pos, -1)], -1)

    # single-base insertions at one place are one insertion
    single = f.is_("i")
    goes_on = np.concatenate(([False], single[1:] & single[:-1] & (read[1:] == read[:-1]) & (f.ref_pos[1:] == f.ref_pos[:-1])))[: len(read)]
    heads = np.flatnonzero(~goes_on)
    times = np.diff(np.append(heads, len(read)))
    run_len = np.add.reduceat(own_len, heads) if len(heads) else own_len
    n = np.where(single[heads], times, f.num[heads])

    code, at, r = f.code[heads], f.ref_pos[heads], read[heads]
    is_ = lambda some: np.isin(code, np.frombuffer(some, np.uint8))
    subs = letters(f.struct.field("sub"))[heads]
    base = np.where(is_(b"X"), np.where(subs > 0, subs, ord("N")), np.append(own_data, np.uint8(0))[np.where(own_len[heads] > 0, own_at[heads], -1)]).astype(np.uint8)
    known = upper(letters(f.struct.field("ref")))[heads]
    theirs = np.where(is_(b"XB"), np.where(known > 0, known, reference(r, at)), 0).astype(np.uint8)
    wide = is_(b"DN")
    seen = np.where(wide, (at < hi[r]) & (at + n > lo[r]), (at >= lo[r]) & (at < hi[r]))
    stays = np.flatnonzero(seen & (is_(b"XIiDNSH") | (is_(b"B") & (theirs > 0) & (upper(base) != theirs))))

    # stored stretches, base by base
    s = np.flatnonzero(f.is_("b"))
    size = np.minimum(np.maximum(f.num[s], 0), own_len[s])
    e = np.repeat(s, size)
    j = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
    e_at, e_base = f.ref_pos[e] + j, own_data[own_at[e] + j]
    e_theirs = reference(read[e], e_at)
    x = np.flatnonzero((e_theirs > 0) & (upper(e_base) != e_theirs) & (e_at >= lo[read[e]]) & (e_at < hi[read[e]]))
    e, j, e_at, e_base, e_theirs = e[x], j[x], e_at[x], e_base[x], e_theirs[x]

    order = np.lexsort((np.concatenate((np.zeros(len(stays), np.int64), j)), np.concatenate((place[heads[stays]], e))))
    both = lambda first, second: np.concatenate((first, second))[order]
    zero, ones = np.zeros(len(e), np.int64), np.ones(len(e), np.int64)
    code, n, r = code[stays], n[stays], r[stays]
    letter, whole = is_(b"XB"), is_(b"Ii")
    out_read = both(r, read[e])
    out_code = both(np.where(letter, ord("X"), np.where(whole, ord("I"), code)), np.full(len(e), ord("X"))).astype(np.uint8)
    length = both(np.where(letter, 1, np.where(is_(b"DN"), n, 0)), ones)
    clip = both(np.where(whole | is_(b"SH"), n, 0), zero)
    qual = both(np.where(is_(b"X"), quality(r, pos[heads[stays]]), np.where(is_(b"B"), n, -1)), quality(read[e], pos[e] + j))
    # bases: letters lie behind the payloads in one buffer; a run's payloads are next to each other once they are gathered
    payloads = gathered(own_data, own_at, np.where(f.is_("Ii"), own_len, 0))
    begin = np.concatenate(([0], np.cumsum(np.where(f.is_("Ii"), own_len, 0))))[heads[stays]]
    source = np.concatenate((payloads, base[stays], e_base))
    starts = both(np.where(whole, begin, len(payloads) + np.arange(len(stays))), len(payloads) + len(stays) + np.arange(len(e)))
    n_bases = both(np.where(whole, run_len[stays], np.where(letter, 1, 0)), ones)
    ref_base = both(theirs[stays], e_theirs)
    columns = [
        strings(out_code, np.ones(len(order), np.int64)), pa.array((both(at[stays], e_at) - numbers(origin)[out_read]).astype(np.int32)), pa.array(length.astype(np.int32)), strings(gathered(source, starts, n_bases), n_bases),
        pa.array(qual.astype(np.int32)), strings(ref_base[ref_base > 0], (ref_base > 0).astype(np.int64), ref_base > 0), pa.array(clip.astype(np.int32)),
    ]
    made = pa.StructArray.from_arrays(columns, names=[c.name for c in MISMATCH.fields])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(out_read, np.arange(len(features) + 1)).astype(np.int32)), made)


def mismatches(features: Column, ref: Column | None = None, ref_start: Column | None = None, quals: Column | None = None, window_start=None, window_end=None, origin: int | Column = 0) -> Column:
    """array<struct<code, ref_pos, length, bases, qual, ref_base, clip_length>> of a read's differences in reference order.

    quals: array<int> of the read or null; the window is half-open, and positions are given less `origin`. Single-base insertions
    at one place are one insertion. Stored bases (B, b) are compared with the reference, a B's own or that of `ref` (from ref_start on),
    and are no difference where it is not known. Null features are none.
    """
    or_null = lambda c, kind: F.lit(None).cast(kind) if c is None else c
    number = lambda c, kind: (c if isinstance(c, Column) else F.lit(c)).cast(kind)
    lo, hi = (number(none if c is None else c, "long") for c, none in ((window_start, -(1 << 31)), (window_end, (1 << 31) - 1)))
    return _differences(_listed(features, FEATURES), or_null(ref, "string"), number(0 if ref_start is None else ref_start, "int"), _listed(or_null(quals, "array<int>"), "array<int>"), lo, hi, number(origin, "int"))


def mismatch_rows(reads: DataFrame, *keep: str, window_start=None, window_end=None, origin: int | Column = 0) -> DataFrame:
    """One row a difference, beside the columns `keep` of its read. reads: features, ref, ref_start, and quals if it has them."""
    quals = F.col("quals") if "quals" in reads.columns else None
    found = mismatches(F.col("features"), F.col("ref"), F.col("ref_start"), quals, window_start, window_end, origin)
    return reads.select(*keep, F.explode(found).alias("difference")).select(*keep, "difference.*")
