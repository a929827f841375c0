"""Tags as one VARIANT a read: `{"NM": {"t": "i", "v": 3}, "XB": {"t": "B", "s": "c", "v": [-1, 2]}}`.

A map of structs holds six nullable fields for every tag; a variant holds each value in its own type, and a path reaches one tag without the
others. Of a name that comes twice the last value stays; B keeps its subtype as `s`; H stays text; i and B of whole numbers are longs.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.flags import _c
from readloom.functions.flat import gathered, offsets_of, spans, strings


def _quoted(text: pa.Array) -> pa.Array:
    """Texts as JSON strings."""
    plain = pc.replace_substring(pc.replace_substring(text, "\\", "\\\\"), '"', '\\"')
    out = pc.binary_join_element_wise('"', plain, '"', "")
    odd = pc.match_substring_regex(text, "[\\x00-\\x1f]").to_numpy(zero_copy_only=False)
    if odd.any():
        rare = iter([json.dumps(x, ensure_ascii=False) for x in text.filter(pa.array(odd)).to_pylist()])
        out = pa.array([next(rare) if o else x for o, x in zip(odd, out.to_pylist(), strict=True)], pa.string())
    return out


def _real(text: pa.Array) -> pa.Array:
    """Numbers as JSON; those that JSON has no number for as strings."""
    return pa.array([repr(x) if abs(x) < float("inf") else f'"{x}"' for x in pc.cast(text, pa.float64()).to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _json(fields: pa.Array) -> pa.Array:
    """JSON texts of the tags of a batch of reads, all tags of one type at once."""
    items, bounds = fields.flatten(), offsets_of(fields)
    data, at, size = spans(items)
    data = np.append(data, np.uint8(0))
    byte = lambda k: np.where(size > k, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int64)
    key = np.repeat(np.arange(len(fields)), np.diff(bounds)) * 65536 + byte(0) * 256 + byte(1)
    last = np.sort(len(key) - 1 - np.unique(key[::-1], return_index=True)[1])
    kind, row = byte(3)[last], key[last] // 65536
    at, size = at[last], size[last]
    piece = lambda mask, skip: strings(gathered(data, at[mask] + skip, np.maximum(0, size[mask] - skip)), np.maximum(0, size[mask] - skip))
    values, n = np.full(len(row), None, object), len(row)
    whole, real, array = np.isin(kind, np.frombuffer(b"iIcCsS", np.uint8)), kind == ord("f"), kind == ord("B")
    text = ~(whole | real | array)
    for mask, made in ((whole, lambda m: pc.cast(pc.cast(piece(m, 5), pa.int64()), pa.string())), (real, lambda m: _real(piece(m, 5))), (text, lambda m: _quoted(piece(m, 5)))):
        if mask.any():
            values[mask] = pc.binary_join_element_wise('"v":', made(mask), "").to_pylist()
    if array.any():
        sub = np.where(size > 5, data[np.minimum(at + 5, len(data) - 1)], 0)
        for floats in (False, True):
            mask = array & ((sub == ord("f")) == floats)
            split = pc.split_pattern(piece(mask, 7), ",")
            parts = split.flatten()
            some = pc.greater(pc.binary_length(parts), 0)
            numbers = parts.filter(some)
            numbers = _real(numbers) if floats else pc.cast(pc.cast(numbers, pa.int64()), pa.string())
            ends = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[offsets_of(split)]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), numbers), ",")
            values[mask] = [f'"s":"{chr(s) if s else ""}","v":[{x}]' for s, x in zip(sub[mask], joined.to_pylist(), strict=True)]
    letters = strings(np.where(kind > 0, kind, ord("Z")).astype(np.uint8), np.ones(n, np.int64))
    names = _quoted(strings(gathered(data, at, np.minimum(size, 2)), np.minimum(size, 2)))
    entries = pc.binary_join_element_wise(names, ':{"t":"', letters, '",', pa.array(values, pa.string()), "}", "")
    inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(fields) + 1)).astype(np.int32)), entries), ",")
    out = pc.binary_join_element_wise("{", inner, "}", "")
    return pc.if_else(fields.is_null(), pa.scalar(None, pa.string()), out) if fields.null_count else out


def tags_variant(fields: Column | str) -> Column:
    """VARIANT of SAM fields such as `NM:i:3`; null for null, an empty object for none."""
    return F.parse_json(_json(_c(fields)))


def variant_tag(tags: Column | str, name: str, kind: str = "string") -> Column:
    """The value of one tag as a Spark type (`bigint`, `double`, `string`, `array<bigint>` ...); null where the read has none or another type."""
    return F.try_variant_get(_c(tags), f"$.{name}.v", kind)


def variant_tag_type(tags: Column | str, name: str) -> Column:
    """SAM type of one tag, with the subtype after it for arrays (`i`, `Bc`); null where the read has none."""
    part = lambda p: F.try_variant_get(_c(tags), f"$.{name}.{p}", "string")
    return F.concat(part("t"), F.coalesce(part("s"), F.lit("")))


def variant_tags(tags: Column | str) -> Column:
    """map<string, variant> of all tags, each `{"t", "v"}`."""
    return _c(tags).cast("map<string,variant>")
