"""Read features of aligned reads: CIGAR, bases and reference walked at once, all reads of a batch together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.cigar import OPS
from readloom.functions.features import BASES
from readloom.functions.flags import _listed
from readloom.functions.flat import gathered, letters, numbers, offsets_of, spans, strings, upper
from readloom.model import FEATURE, MalformedInputError

_MATCH, _INSERT, _REACH = b"M=X", b"IS", b"DN"


def _is(op: np.ndarray, some: bytes) -> np.ndarray:
    return np.isin(op, np.frombuffer(some, np.uint8))


def _codes() -> np.ndarray:
    """Code of a substitution by reference base and base: the base's place among those of BASES without the reference's own."""
    out = np.full((256, 256), -1, np.int64)
    for r in range(256):
        others = [b for b in BASES if b != (chr(r) if chr(r) in BASES else "N")]
        for k, b in enumerate(others):
            out[r, ord(b)] = k
    return out


_CODE = _codes()


@F.arrow_udf(T.ArrayType(FEATURE))
def _walked(cigar: pa.Array, bases: pa.Array, start: pa.Array, ref: pa.Array, ref_start: pa.Array, quals: pa.Array) -> pa.Array:
    n_reads = len(cigar)
    ops = cigar.flatten()
    op = letters(ops.field("op"))
    size = numbers(ops.field("len"))
    read = np.repeat(np.arange(n_reads), np.diff(offsets_of(cigar)))
    (base_data, base_at, base_len), (ref_data, ref_at, ref_len) = spans(bases), spans(ref)
    has_bases, has_ref = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (bases, ref))
    first = np.searchsorted(read, np.arange(n_reads))

    def places(steps: np.ndarray) -> np.ndarray:
        """Sums of steps before each op, from its read's first op on."""
        sums = np.concatenate(([0], np.cumsum(steps)))
        return sums[:-1] - sums[first[read]]

    on_read = np.where(_is(op, _MATCH + _INSERT), size, 0)
    pos = places(on_read)
    ref_pos = numbers(start)[read] + places(np.where(_is(op, _MATCH + _REACH), size, 0))
    whole = np.bincount(read, on_read, n_reads).astype(np.int64)
    some = np.bincount(read, minlength=n_reads) > 0
    if (some & has_bases & (whole != base_len)).any():
        raise ValueError(f"{MalformedInputError.__name__}: a CIGAR's length is not that of the read's bases")

    # bases that stand against the reference, one by one
    m = np.flatnonzero(_is(op, _MATCH) & has_bases[read] & has_ref[read])
    each = np.repeat(m, size[m])
    j = np.arange(len(each)) - np.repeat(np.cumsum(size[m]) - size[m], size[m])
    own = upper(np.append(base_data, np.uint8(0))[base_at[read[each]] + pos[each] + j])
    at = ref_pos[each] + j - numbers(ref_start)[read[each]]
    inside = (at >= 0) & (at < ref_len[read[each]])
    theirs = np.where(inside, upper(np.append(ref_data, np.uint8(0))[np.where(inside, ref_at[read[each]] + at, 0)]), 0).astype(np.uint8)
    equal = np.uint8(ord("="))
    own = np.where(own == equal, np.where(theirs == 0, np.uint8(ord("N")), theirs), own)
    x = np.flatnonzero(own != theirs)
    each, j, own, theirs = each[x], j[x], own[x], theirs[x]
    known = _is(own, BASES.encode())

    # ops that are features as they are; against no reference, stretches of stored bases
    o = np.flatnonzero((_is(op, _INSERT + _REACH + b"HP") | (_is(op, _MATCH) & has_bases[read] & ~has_ref[read])) & (size > 0))
    stored = _is(op[o], _MATCH)
    order = np.lexsort((np.concatenate((j, np.zeros(len(o), np.int64))), np.concatenate((each, o))))
    key = np.concatenate((each, o))[order]
    code = np.concatenate((np.where(known, ord("X"), ord("B")).astype(np.uint8), np.where(stored, ord("b"), op[o]).astype(np.uint8)))[order]
    pos, ref_pos = (np.concatenate((v[each] + j, v[o]))[order] for v in (pos, ref_pos))
    q_at = offsets_of(quals)[:-1][read[each]] + pos[np.argsort(order)[: len(each)]]
    q_data, q_len = numbers(quals.flatten()), np.diff(offsets_of(quals))[read[each]]
    q = np.where(q_len > 0, np.append(q_data, 0)[np.where(q_len > 0, q_at, -1)], -1)
    num = np.concatenate((np.where(known, _CODE[theirs, own], q), size[o]))[order]

    # payloads: an insertion's, a clip's or a stretch's bases (N where they are not known), and B's base
    source = np.concatenate((base_data, np.frombuffer(b"N", np.uint8), own))
    holds = _is(op[o], _INSERT) | stored
    own_at = len(base_data) + 1 + np.arange(len(each))
    n_payload = np.concatenate((np.where(known, 0, 1), np.where(holds, size[o], 0)))[order]
    from_read = np.concatenate((np.zeros(len(each), bool), holds & has_bases[read[o]]))[order]
    from_own = np.concatenate((~known, np.zeros(len(o), bool)))[order]
    begin = np.where(from_read, base_at[read[key]] + pos, np.where(from_own, np.concatenate((own_at, np.zeros(len(o), np.int64)))[order], len(base_data)))
    step = from_read | from_own  # otherwise the one N, over and over
    inner = np.arange(n_payload.sum()) - np.repeat(np.cumsum(n_payload) - n_payload, n_payload)
    payload = upper(source[np.repeat(begin, n_payload) + np.where(np.repeat(step, n_payload), inner, 0)])
    one = np.isin(code, np.frombuffer(b"XB", np.uint8))
    is_x = code == ord("X")
    base_of, ref_of = (np.concatenate((v, np.zeros(len(o), np.uint8)))[order] for v in (own, theirs))
    fields = [
        strings(code, np.ones(len(code), np.int64)), pa.array(pos.astype(np.int32)), pa.array(ref_pos.astype(np.int32)), pa.array(num.astype(np.int32)),
        strings(payload, n_payload, n_payload > 0), strings(ref_of[one & (ref_of > 0)], (one & (ref_of > 0)).astype(np.int64), one & (ref_of > 0)), strings(base_of[is_x], is_x.astype(np.int64), is_x),
    ]
    made = pa.StructArray.from_arrays(fields, names=[f.name for f in FEATURE.fields])
    bounds = np.searchsorted(read[key], np.arange(n_reads + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), made, mask=pa.array(~some))


def features_from_alignment(cigar: Column, bases: Column, start: Column, ref: Column, ref_start: Column, quals: Column | None = None) -> Column:
    """Read features of an aligned read, in the order of the read: what `cigar_from_features`, `read_bases` and `mismatches` work on.

    cigar: array<struct<op, len>>; ref: reference from ref_start on. M, = and X are compared base by base: a different base of ACGTN is an
    X (num: its code in the plain substitution matrix), another letter a B with its quality from `quals` (-1 where there is none); a base
    `=` is the reference's. I and S hold their bases, D N H P their length. Beyond the reference known every base is a difference.

    Null bases (`*`): I and S hold Ns, nothing is compared. Null ref: what aligns is stored as stretches b. A null or empty CIGAR gives null;
    ops of length 0 give nothing; a CIGAR that does not fit the bases raises.
    """
    quals = F.lit(None) if quals is None else quals
    return _walked(_listed(cigar, OPS.simpleString()), bases, start.cast("int"), ref, ref_start.cast("int"), _listed(quals, "array<int>"))
