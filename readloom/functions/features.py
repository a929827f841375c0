"""Read features: places on the reference, lengths, substitutions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.flat import letters, numbers, offsets_of, spans, strings, upper
from readloom.model import FEATURE

#: Rows of a substitution matrix, fixed by the format.
BASES = "ACGTN"


def reference_shift(x: Column) -> Column:
    """How much a feature makes the reference position run ahead of the read position."""
    return F.when(x["code"].isin("D", "N"), x["num"]).when(x["code"].isin("I", "S"), -F.length(x["payload"])).when(x["code"] == "i", -1).otherwise(0)


@F.arrow_udf(T.ArrayType(FEATURE))
def _placed(features: pa.Array, start: pa.Array) -> pa.Array:
    """One pass over all features of a batch: sums of shifts, less what they were before each read."""
    offsets = features.offsets.to_numpy()
    x = features.flatten() if len(features) else features.values
    first = offsets - offsets[0]
    code, num = x.field("code"), x.field("num").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.utf8_length(x.field("payload").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    is_ = lambda *c: pc.is_in(code, pa.array(c)).to_numpy(zero_copy_only=False)
    shift = np.where(is_("D", "N"), num, np.where(is_("I", "S"), -length, np.where(is_("i"), -1, 0)))
    sums = np.concatenate(([0], np.cumsum(shift)))
    read = np.repeat(np.arange(len(features)), np.diff(first))
    at = x.field("pos").fill_null(0).to_numpy(zero_copy_only=False) + start.fill_null(0).to_numpy(zero_copy_only=False)[read] + sums[:-1] - sums[first[:-1]][read]
    fields = [pa.array(at.astype(np.int32)) if f.name == "ref_pos" else x.field(f.name) for f in x.type]
    made = pa.StructArray.from_arrays(fields, fields=list(x.type))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), made, mask=features.is_null() if features.null_count else None)


def place_features(features: Column, start: Column) -> Column:
    """features with ref_pos set from their positions on the read and the features before them; null features stay null."""
    return _placed(features, start.cast("int"))


def length_on_ref(features: Column, read_length: Column) -> Column:
    """Reference bases under a mapped read."""
    return (read_length + F.coalesce(F.aggregate(features, F.lit(0), lambda a, x: a + reference_shift(x).cast("int")), F.lit(0))).cast("int")


def substitution(matrix: Column, ref_base: Column, code: Column) -> Column:
    """The base that substitution `code` stands for.

    matrix: array of five ints, for the reference bases A, C, G, T and N; each packs, from its high bits on, the codes of the four
    other bases in the order of BASES. An unknown reference base counts as N, an unknown code gives null.
    """
    base = F.upper(ref_base)
    row = _index(base)
    packed = F.get(matrix, row)
    others = F.replace(F.lit(BASES), F.when(row == 4, F.lit("N")).otherwise(base), F.lit(""))
    out = F.lit(None).cast("string")
    for j in range(3, -1, -1):
        out = F.when(F.shiftright(packed, 6 - 2 * j).bitwiseAND(F.lit(3)) == code, F.substring(others, j + 1, 1)).otherwise(out)
    return out


@F.arrow_udf(T.ArrayType(FEATURE))
def _resolved(features: pa.Array, ref: pa.Array, start: pa.Array, matrix: pa.Array) -> pa.Array:
    """All features of a batch at once: the reference's letter at each X and B, and what an X's code stands for beside it."""
    x, bounds = features.flatten(), offsets_of(features)
    read = np.repeat(np.arange(len(features)), np.diff(bounds))
    code, (data, at, size), rows = letters(x.field("code")), spans(ref), offsets_of(matrix)
    i = numbers(x.field("ref_pos")) - numbers(start)[read]
    inside = (i >= 0) & (i < size[read]) & pc.is_valid(x.field("ref_pos")).to_numpy(zero_copy_only=False) & pc.is_valid(start).to_numpy(zero_copy_only=False)[read]
    theirs = np.where(inside, upper(np.append(data, np.uint8(0))[np.where(inside, at[read] + i, -1)]), 0).astype(np.uint8)
    is_x, is_b = inside & (code == ord("X")), inside & (code == ord("B"))
    row = _ROW[theirs]
    packed = np.append(numbers(matrix.flatten()), 0)[np.where(rows[1:][read] - rows[:-1][read] > row, rows[:-1][read] + row, -1)]
    place = np.full(len(code), -1)
    for k in range(3, -1, -1):
        place[packed >> (6 - 2 * k) & 3 == numbers(x.field("num"))] = k
    known = is_x & (place >= 0) & pc.is_valid(x.field("num")).to_numpy(zero_copy_only=False)
    sub = strings(_OTHERS[row, np.maximum(place, 0)][known], known.astype(np.int64), known)
    either = is_x | is_b
    changed = {
        "ref": pc.if_else(pa.array(either), strings(theirs[either], either.astype(np.int64)), x.field("ref")),
        "sub": pc.if_else(pa.array(is_x), sub, pc.if_else(pa.array(is_b), x.field("payload"), x.field("sub"))),
    }
    made = pa.StructArray.from_arrays([changed.get(f.name, x.field(f.name)) for f in x.type], names=[f.name for f in x.type])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), made, mask=features.is_null() if features.null_count else None)


#: Row of a substitution matrix by a reference letter, and the four other bases of each row.
_ROW = np.full(256, 4)
_ROW[[ord(b) for b in BASES]] = np.arange(5)
_OTHERS = np.array([[ord(b) for b in BASES if b != own] for own in BASES], np.uint8)


def resolved(features: Column, ref: Column, start: Column, matrix: Column) -> Column:
    """features with ref and sub filled in for X and B that lie on `ref`, the reference from `start` on; see `substitution` for the matrix."""
    return _resolved(features, ref, start.cast("int"), matrix.cast("array<int>"))


def _index(base: Column) -> Column:
    out = F.lit(4)
    for k, b in enumerate(BASES[:4]):
        out = F.when(base == b, k).otherwise(out)
    return out
