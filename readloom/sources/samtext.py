"""SAM lines to columns and back, a batch of lines at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.cigar import OPS, cigar_texts, parsed_cigars
from readloom.functions.flags import _listed
from readloom.functions.flat import gathered, offsets_of, spans, strings
from readloom.functions.tags import quality_lists, quality_texts
from readloom.model import TAG_VALUE, MalformedInputError

_WHOLE = np.frombuffer(b"iIcCsS", np.uint8)

#: Fields of a parsed line, as they stand in it; rnext is `=` where the line says so.
PARSED = T.StructType(
    [T.StructField("read_name", T.StringType()), T.StructField("flags", T.IntegerType()), T.StructField("rname", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("mapping_quality", T.IntegerType()), T.StructField("cigar", OPS),
     T.StructField("reach", T.IntegerType()), T.StructField("rnext", T.StringType()), T.StructField("pnext", T.IntegerType()), T.StructField("template_length", T.IntegerType()), T.StructField("read_bases", T.StringType()),
     T.StructField("quals", T.ArrayType(T.IntegerType())), T.StructField("tags", T.MapType(T.StringType(), TAG_VALUE))]
)


def _ints(text: pa.Array) -> np.ndarray:
    return pc.cast(text, pa.int64()).to_numpy(zero_copy_only=False)


def _tags(data: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, n_rows: int) -> pa.Array:
    """Maps of tags from their fields (row, place, length) in a buffer that ends in a zero; of a name that comes twice the last stays."""
    key = row * 65536 + np.where(size > 0, data[at], 0).astype(np.int64) * 256 + np.where(size > 1, data[np.minimum(at + 1, len(data) - 1)], 0)
    last = np.sort(len(key) - 1 - np.unique(key[::-1], return_index=True)[1])
    row, at, size = row[last], at[last], size[last]
    kind = np.where(size > 3, data[np.minimum(at + 3, len(data) - 1)], 0).astype(np.uint8)
    v_at, v_size = at + 5, np.maximum(size - 5, 0)
    is_ = lambda some: np.isin(kind, np.frombuffer(some, np.uint8))
    n = len(row)

    def text(mask: np.ndarray, at: np.ndarray = v_at, size: np.ndarray = v_size) -> pa.Array:
        return strings(gathered(data, at[mask], size[mask]), size[mask])

    def spread(values: pa.Array, mask: np.ndarray) -> pa.Array:
        """The values where the mask holds, nulls elsewhere."""
        place = np.cumsum(mask) - 1
        return values.take(pa.array(np.where(mask, place, 0), mask=~mask)) if len(values) else pa.nulls(n, values.type)

    whole, real, shown, array = np.isin(kind, _WHOLE), is_(b"f"), is_(b"AZH"), is_(b"B")
    i = np.zeros(n, np.int64)
    i[whole] = _ints(text(whole))
    if is_(b"H").any():
        i[is_(b"H")] = [int(x or "0", 16) for x in text(is_(b"H")).to_pylist()]
    has_i = whole | is_(b"H")
    sub = np.where(array & (v_size > 0), data[np.minimum(v_at, len(data) - 1)], 0).astype(np.uint8)

    def lists(mask: np.ndarray, kind: pa.DataType) -> pa.Array:
        split = pc.split_pattern(text(mask, v_at + 2, np.maximum(v_size - 2, 0)), ",")
        items = split.flatten()
        some = pc.greater(pc.binary_length(items), 0)
        bounds = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[offsets_of(split)]
        return spread(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pc.cast(items.filter(some), kind)), mask)

    b = array & (sub > 0)
    fields = [
        strings(kind[kind > 0], (kind > 0).astype(np.int64)), pa.array(i, mask=~has_i), spread(pc.cast(text(real), pa.float64()), real), spread(text(shown), shown),
        lists(array & (sub != ord("f")), pa.int64()), lists(array & (sub == ord("f")), pa.float64()), strings(sub[b], b.astype(np.int64), array),
    ]
    values = pa.StructArray.from_arrays(fields, names=[f.name for f in TAG_VALUE.fields])
    keys = strings(gathered(data, at, np.minimum(size, 2)), np.minimum(size, 2))
    return pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)), keys, values)


def parsed(lines: pa.Array, names: list[str] | None = None) -> pa.StructArray:
    """The fields (all, or those named) of SAM lines. A line of under 11 fields, or with a number that is none, raises; starts are 0-based."""
    return fields(*spans(lines), names)


def fields(data: np.ndarray, begin: np.ndarray, size: np.ndarray, names: list[str] | None = None) -> pa.StructArray:
    """`parsed` for lines that lie in a buffer, at `begin` and of `size` bytes."""
    n = len(begin)
    end = begin + size
    tabs = np.flatnonzero(data == 9)
    first, last = np.searchsorted(tabs, begin), np.searchsorted(tabs, end)
    if (last - first < 10).any():
        raise ValueError(f"{MalformedInputError.__name__}: a SAM line has under 11 fields")
    tabs = np.append(tabs, len(data))
    data = np.append(data, np.uint8(0))  # so that a place at the end can be asked for

    def place(k: int) -> tuple[np.ndarray, np.ndarray]:
        a = begin if k == 0 else tabs[first + k - 1] + 1
        b = np.where(first + k < last, tabs[first + k], end)
        return a, b - a

    def text(k: int, star: bool = True) -> pa.Array:
        a, length = place(k)
        valid = ~((length == 1) & (data[a] == ord("*"))) if star else None
        length = np.where(valid, length, 0) if star else length
        return strings(gathered(data, a, length), length, valid)

    number = lambda k: pc.cast(text(k, False), pa.int32())
    less = lambda x: pc.subtract(x, pa.scalar(1, pa.int32()))

    @cache
    def cigars() -> tuple[pa.Array, np.ndarray]:
        return parsed_cigars(data, *place(5), np.zeros(n, bool))

    def tags() -> pa.Array:
        more = np.maximum(last - first - 10, 0)
        row = np.repeat(np.arange(n), more)
        k = np.repeat(first + 10, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        t_at = tabs[k] + 1
        t_end = np.where(k + 1 < last[row], tabs[np.minimum(k + 1, len(tabs) - 1)], end[row])
        return _tags(data, row, t_at, t_end - t_at, n)

    columns = {
        "read_name": lambda: text(0), "flags": lambda: number(1), "rname": lambda: text(2, False), "start": lambda: less(number(3)), "mapping_quality": lambda: number(4), "cigar": lambda: cigars()[0],
        "reach": lambda: pa.array(cigars()[1], pa.int32()), "rnext": lambda: text(6, False), "pnext": lambda: less(number(7)), "template_length": lambda: number(8), "read_bases": lambda: text(9),
        "quals": lambda: quality_lists(data, *place(10)), "tags": tags,
    }
    names = PARSED.fieldNames() if names is None else names
    return pa.StructArray.from_arrays([columns[c]() for c in names], names=names)


@cache
def line_parser(names: tuple[str, ...] = tuple(PARSED.fieldNames())):
    """A function of a column of lines that gives their fields of those names; null for header lines and lines that are null or empty.

    A line's end may be a carriage return. Lines are judged here, as a filter on them would have Spark make each line again.
    """

    @F.arrow_udf(T.StructType([PARSED[c] for c in names]))
    def parse(lines: pa.Array) -> pa.Array:
        data, at, size = spans(lines)
        padded = np.append(data, np.uint8(0))
        for _ in range(2):
            size = size - ((size > 0) & (padded[at + size - 1] == 13))
        some = (size > 0) & (padded[at] != ord("@"))
        if some.all():
            return fields(data, at, size, names)
        return fields(data, at[some], size[some], names).take(pa.array(np.cumsum(some) - 1, mask=~some))

    return parse


def _joined(items: pa.Array, bounds: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items.cast(pa.string())), between)


def _cast_items(a: pa.Array) -> pa.Array:
    """Texts of arrays of numbers, after commas."""
    items = a.flatten()
    return _joined(_number_text(items), offsets_of(a), ",")


def _number_text(a: pa.Array) -> pa.Array:
    """Numbers as text; of whole floats the point stays."""
    if a.null_count == len(a):
        return pa.nulls(len(a), pa.string())
    if not pa.types.is_floating(a.type):
        return pc.cast(a, pa.string())
    return pa.array([None if x is None else repr(x) for x in a.to_pylist()], pa.string())


_TEXTS = T.StructType([T.StructField(c, T.StringType()) for c in ("cigar", "quality", "tags")])


def text_parts(cigar: str, quals: str, tags: str) -> Column:
    """CIGAR and quality as SAM text (`*` where there is none), and the tags' fields after tabs, each with one before it."""
    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in TAG_VALUE.fields) + ">"

    def whole(x: Column) -> Column:
        """A value without null lists; a list of reals without a type is one of `f`."""
        real = x["af"].isNotNull()
        sub = F.when(real & (F.coalesce(x["sub"], F.lit("")) == ""), F.lit("f")).otherwise(x["sub"])
        return x.withField("sub", sub).withField("ai", _listed(F.when(~real, x["ai"]), "array<bigint>")).withField("af", _listed(x["af"], "array<double>")).cast(kind)

    tags_ = F.coalesce(F.transform_values(tags, lambda _, x: whole(x)), F.create_map().cast(f"map<string,{kind}>"))
    return _text_parts(_listed(F.col(cigar), OPS.simpleString()), _listed(F.col(quals), "array<int>"), tags_)


@F.arrow_udf(_TEXTS)
def _text_parts(cigar: pa.Array, quals: pa.Array, tags: pa.Array) -> pa.Array:
    t_bounds = np.asarray(tags.offsets)
    keys, values = (x.slice(t_bounds[0], t_bounds[-1] - t_bounds[0]) for x in (tags.keys, tags.items))
    kind, sub = (pc.fill_null(values.field(c), "") for c in ("kind", "sub"))
    ai, af, s = values.field("ai"), values.field("af"), values.field("s")
    is_array = pc.equal(kind, "B")
    guess = pc.if_else(pc.not_equal(sub, ""), sub, "i")
    listed = pc.if_else(pc.greater(pc.list_value_length(af), 0), _cast_items(af), _cast_items(ai))
    array_text = pc.binary_join_element_wise(guess, listed, ",")
    plain = pc.coalesce(s, pc.cast(values.field("i"), pa.string()), _number_text(values.field("f")), pa.scalar(""))
    text = pc.if_else(is_array, array_text, plain)
    said = pc.if_else(pc.is_in(kind, pa.array(["c", "C", "s", "S", "I"])), "i", kind)
    texts = pc.binary_join_element_wise("\t", keys, ":", said, ":", text, "")
    return pa.StructArray.from_arrays([cigar_texts(cigar), quality_texts(quals), _joined(texts, t_bounds - t_bounds[0], "")], names=_TEXTS.fieldNames())
