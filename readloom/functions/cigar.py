"""CIGARs: as text, as array<struct<op, len>>, packed, and from read features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.flags import _c, _listed
from readloom.functions.flat import Positional, gathered, letters, numbers, offsets_of, spans, strings
from readloom.model import CIGAR_OPS, FEATURE

FEATURES = f"array<{FEATURE.simpleString()}>"


def _op(op, n) -> Column:
    return F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), n.cast("int").alias("len"))


OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("len", T.IntegerType())]))
_REACH = np.frombuffer(b"MDN=X", np.uint8)


def parsed_cigars(data: np.ndarray, at: np.ndarray, size: np.ndarray, missing: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """CIGAR arrays of texts in a buffer (null for `*` and where missing), and how much reference each covers; what is no op is passed over."""
    flat = gathered(data, at, size)
    row, bounds = np.repeat(np.arange(len(at)), size), np.concatenate(([0], np.cumsum(size)))
    digit = (flat >= 48) & (flat <= 57)
    ends = np.flatnonzero(~digit)
    starts = np.maximum(np.concatenate(([0], ends[:-1] + 1))[: len(ends)], bounds[row[ends]])
    good = (ends > starts) & np.isin(flat[ends], np.frombuffer(CIGAR_OPS.encode(), np.uint8))
    ends, starts = ends[good], starts[good]
    n_digits = ends - starts
    inner = np.arange(n_digits.sum()) - np.repeat(np.cumsum(n_digits) - n_digits, n_digits)
    power = np.repeat(n_digits, n_digits) - 1 - inner
    value = (gathered(flat, starts, n_digits).astype(np.int64) - 48) * 10 ** np.minimum(power, 17)
    length = np.add.reduceat(value, np.cumsum(n_digits) - n_digits) if len(ends) else np.zeros(0, np.int64)
    op = flat[ends]
    items = pa.StructArray.from_arrays([strings(op, np.ones(len(op), np.int64)), pa.array(length, pa.int32())], names=["op", "len"])
    star = missing | (size == 1) & (np.append(data, np.uint8(0))[at] == ord("*"))
    reach = np.bincount(row[ends], np.where(np.isin(op, _REACH), length, 0), len(at)).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[ends], np.arange(len(at) + 1)).astype(np.int32)), items, mask=pa.array(star)), reach


@F.arrow_udf(OPS)
def _parsed(text: pa.Array) -> pa.Array:
    return parsed_cigars(*spans(text), text.is_null().to_numpy(zero_copy_only=False))[0]


def parse_cigar(text: Column | str = "cigar") -> Column:
    """array<struct<op string, len int>>; `*` and null give null."""
    return _parsed(_c(text))


def cigar_texts(cigar: pa.Array) -> pa.Array:
    ops = cigar.flatten()
    items = pc.binary_join_element_wise(pc.cast(ops.field("len"), pa.string()), ops.field("op"), "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets_of(cigar).astype(np.int32)), items), "")
    return pc.if_else(pc.equal(text, ""), "*", text)


@F.arrow_udf(T.StringType())
def _texts(cigar: pa.Array) -> pa.Array:
    return cigar_texts(cigar)


def cigar_string(ops: Column) -> Column:
    """Text of a CIGAR array, `*` if there are no ops."""
    return _texts(ops)


def cigar_length_on_ref(ops: Column) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda a, x: a + x["len"])


def _clip(op: Column) -> Column:
    return F.when(op["op"].isin("S", "H"), op["len"]).otherwise(0)


def leading_clip(ops: Column) -> Column:
    """Length of the first op if it is S or H, else 0."""
    return F.when(F.size(ops) > 0, _clip(F.get(ops, F.lit(0)))).otherwise(0)


def trailing_clip(ops: Column) -> Column:
    return F.when(F.size(ops) > 0, _clip(F.element_at(ops, -1))).otherwise(0)


def packed_cigar(ops: Column) -> Column:
    """array<int> of (length << 4) | op code."""
    return F.transform(ops, lambda x: F.shiftleft(x["len"], 4).bitwiseOR(_code(x["op"])))


def _code(op: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(CIGAR_OPS):
        out = F.when(op == name, k).otherwise(out)
    return out


def _merged(op: np.ndarray, size: np.ndarray, read: np.ndarray, n_reads: int, mask: pa.Array | None = None) -> pa.Array:
    """CIGAR arrays of ops in order, with neighbours of one kind as one op, and without ops of length 0."""
    some = size > 0
    op, size, read = op[some], size[some], read[some]
    begins = np.flatnonzero(np.concatenate(([True], (op[1:] != op[:-1]) | (read[1:] != read[:-1])))[: len(op)])
    size = np.add.reduceat(size, begins) if len(begins) else size
    items = pa.StructArray.from_arrays([strings(op[begins], np.ones(len(begins), np.int64)), pa.array(size.astype(np.int32))], ["op", "len"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(read[begins], np.arange(n_reads + 1)).astype(np.int32)), items, mask=mask)


@F.arrow_udf(OPS)
def _plain(cigar: pa.Array) -> pa.Array:
    ops = cigar.flatten()
    read = np.repeat(np.arange(len(cigar)), np.diff(offsets_of(cigar)))
    return _merged(letters(ops.field("op")), numbers(ops.field("len")), read, len(cigar), cigar.is_null() if cigar.null_count else None)


def merge_cigar(ops: Column) -> Column:
    """A CIGAR array with neighbours of one kind as one op, and without ops of length 0."""
    return _plain(ops)


@F.arrow_udf(OPS)
def _walked(features: pa.Array, start: pa.Array, read_length: pa.Array) -> pa.Array:
    """All reads of a batch at once: a match and an op for each feature, the tail, and neighbours of one kind added up."""
    f = Positional(features, start)
    op = np.where(f.is_("XBb"), ord("M"), np.where(f.is_("i"), ord("I"), f.code)).astype(np.uint8)
    size = np.where(f.is_("XBi"), 1, f.num)
    gap = np.maximum(0, f.ref_pos - f.before)
    used = np.concatenate(([0], np.cumsum(gap + np.where(np.isin(op, np.frombuffer(b"MIS", np.uint8)), size, 0))))
    m = np.uint8(ord("M"))
    lens = f.interleaved(gap, size, numbers(read_length) - (used[f.first[1:]] - used[f.first[:-1]]))
    ops = f.interleaved(np.full(len(op), m), op, np.full(f.n_reads, m))
    read = f.interleaved(f.read, f.read, np.arange(f.n_reads))
    return _merged(ops, lens, read, f.n_reads)


def cigar_from_features(features: Column, start: Column, read_length: Column, mapped: Column | None = None) -> Column:
    """CIGAR array of a mapped read from its features: M for matches and substitutions, neighbours of one kind merged.

    Null features are none; a read that is not `mapped` gives null.
    """
    out = _walked(_listed(features, FEATURES), start.cast("int"), read_length.cast("int"))
    return out if mapped is None else F.when(mapped, out)
