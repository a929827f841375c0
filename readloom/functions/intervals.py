"""Interval predicates; ends are exclusive, and may be infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.flags import _c


def read_span(length_on_ref: Column | str = "length_on_ref") -> Column:
    """Reference bases for overlap tests: a read without any counts as one base at its start."""
    return F.coalesce(F.greatest(_c(length_on_ref), F.lit(1)), F.lit(1))


def overlaps(query_start, query_end, start: Column | str = "start", length_on_ref: Column | str = "length_on_ref") -> Column:
    """Whether a read lies in [query_start, query_end)."""
    return (_c(start) < query_end) & (_c(start) + read_span(length_on_ref) > query_start)


def entry_overlaps(query_start, query_end, start: Column | str = "start", span: Column | str = "span") -> Column:
    """The same for index entries, whose span may be 0: such an entry needs start > query_start."""
    return (_c(start) < query_end) & (_c(start) + _c(span) > query_start)
