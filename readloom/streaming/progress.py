"""Alignments as a stream: the range filter as it is, and counts by slice as rows come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.ranges import range_query


def stream_range(reads: DataFrame, sequence_id: int, start, end) -> DataFrame:
    """Streaming reads in [start, end) of a sequence; stateless."""
    return range_query(reads, sequence_id, start, end)


def slice_progress(reads: DataFrame, width: int = 1000) -> DataFrame:
    """(sequence_id, slice, n_reads, first): running counts by stretch of starts; state is one row for each stretch. Use update or complete mode."""
    return reads.groupBy("sequence_id", F.floor(F.col("start") / width).cast("long").alias("slice")).agg(F.count(F.lit(1)).alias("n_reads"), F.min("start").alias("first"))
