"""Optional tags, qualities, reference checksums, JSON."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.flags import _c, let
from readloom.functions.flat import gathered, numbers, offsets_of, spans, strings
from readloom.model import TAG_VALUE


def last_wins(entries: Column) -> Column:
    """map from array<struct<key, value>> in which the last of equal keys stays, whatever the session's settings; null stays null.

    Entries are sorted by key and place, so equal keys are neighbours, and then by place again.
    """
    by_key = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    kept = let(by_key, lambda a: F.filter(a, lambda e, i: F.coalesce(F.get(a, i + 1)["key"] != e["key"], F.lit(True))))
    in_order = F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(in_order, lambda e: F.struct(e["key"], e["value"])))


def _value(kind: Column, text: Column) -> Column:
    sub = F.substring(text, 1, 1)
    items = F.filter(F.split(F.substring(text, 2, 1 << 30), ","), lambda x: x != "")
    hex_number = F.conv(text, 16, 10).cast("long")
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("i", "I", "c", "C", "s", "S"), text.cast("long")).when(kind == "H", hex_number).alias("i"),
        F.when(kind == "f", text.cast("double")).alias("f"),
        F.when(kind.isin("A", "Z", "H"), text).alias("s"),
        F.when((kind == "B") & (sub != "f"), F.transform(items, lambda x: x.cast("long"))).alias("ai"),
        F.when((kind == "B") & (sub == "f"), F.transform(items, lambda x: x.cast("double"))).alias("af"),
        F.when(kind == "B", sub).alias("sub"),
    ).cast(TAG_VALUE)


def parse_tags(fields: Column) -> Column:
    """map<string, struct<kind, i, f, s, ai, af, sub>> of SAM fields such as `NM:i:3`; a repeated name keeps its last value."""
    entries = F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), _value(F.substring(t, 4, 1), F.substring(t, 6, 1 << 30)).alias("value")))
    return last_wins(entries)


def quality_lists(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Phred values of texts in a buffer; null for `*` and empty ones."""
    some = (size > 0) & ~((size == 1) & (np.append(data, np.uint8(0))[at] == ord("*")))
    size = np.where(some, size, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(gathered(data, at, size).astype(np.int32) - 33), mask=pa.array(~some))


def quality_texts(quals: pa.Array) -> pa.Array:
    """SAM text of arrays of Phred values."""
    bounds, q = offsets_of(quals), numbers(quals.flatten())
    n = np.diff(bounds)
    n = np.where((n > 0) & (np.append(q, 0)[bounds[:-1]] != 255), n, 0)
    text = strings((gathered(q, bounds[:-1], n) + 33).astype(np.uint8), n)
    return pc.if_else(pc.equal(text, ""), "*", text)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _quality_lists(text: pa.Array) -> pa.Array:
    return quality_lists(*spans(text))


@F.arrow_udf(T.StringType())
def _quality_texts(quals: pa.Array) -> pa.Array:
    return quality_texts(quals)


def quality_bytes(text: Column | str) -> Column:
    """array<int> of Phred values from SAM text; null for `*`."""
    return _quality_lists(_c(text))


def quality_string(quals: Column) -> Column:
    """SAM text of an array of Phred values; `*` for null, empty, or a first value of 255."""
    return _quality_texts(quals)


def quality_at(quals: Column, i: int | Column) -> Column:
    """-1 when no qualities are stored, null out of range."""
    return F.when(quals.isNull(), -1).otherwise(F.get(quals, F.lit(i) if isinstance(i, int) else i))


def reference_md5(sequence: Column | str) -> Column:
    """md5 of a sequence, upper-cased and without what lies outside `!` to `~`."""
    return F.md5(F.regexp_replace(F.translate(_c(sequence), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^!-~]", ""))


def get_tag(tags: Column | str, name: str) -> Column:
    """The value of one tag, null where the read has none."""
    return F.try_element_at(_c(tags), F.lit(name))


def block_crc32(content: Column | str) -> Column:
    """CRC-32 of a block of bytes or text, unsigned; null for null."""
    return F.crc32(_c(content).cast("binary"))


def crc32_ok(content: Column | str, recorded: Column | str) -> Column:
    """Whether a block has the checksum that was recorded for it; a block without one passes."""
    return F.coalesce(block_crc32(content) == _c(recorded), F.lit(True))


def to_json(*columns: str) -> Column:
    """A record as JSON without its null fields."""
    return F.to_json(F.struct(*columns))


def json_field(text: Column | str, name: str) -> Column:
    """A top-level field of a JSON text as text; null where it is missing or the text is no JSON."""
    return F.get_json_object(_c(text), f"$.{name}")
