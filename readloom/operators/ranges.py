"""Interval queries and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.intervals import overlaps, read_span


def range_query(reads: DataFrame, sequence_id: int, start, end) -> DataFrame:
    """Reads on a sequence that lie in [start, end); the comparisons on columns reach a Parquet scan."""
    rows = reads.filter((F.col("sequence_id") == sequence_id) & (F.col("start") < end))
    return rows.filter(overlaps(start, end))


def range_join(reads: DataFrame, regions: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Every read with every region (region_id, sequence_id, region_start, region_end) that it lies in.

    Both sides are dealt to bins of `width` bases and meet in an equality join on sequence and bin; a pair counts in its first
    common bin, so none comes twice. Regions must be bounded, as by the sequence's length. Reads without a sequence or start, and regions
    that are empty or hold a null, meet nothing; repeated rows meet each; reads keep their columns, whatever they are called.
    """
    floor = lambda c: F.floor(c / width).cast("long")
    end = F.col("start") + read_span()
    a = reads.select(F.struct(*reads.columns).alias("read"), F.col("sequence_id").alias("seq_a"), F.col("start").alias("from_a"), end.alias("to_a"), F.explode(F.sequence(floor(F.col("start")), floor(end - 1))).alias("bin_a"))
    b = regions.filter("region_end > region_start").select("region_id", F.col("sequence_id").alias("seq_b"), "region_start", "region_end", F.explode(F.sequence(floor(F.col("region_start")), floor(F.col("region_end") - 1))).alias("bin_b"))
    pairs = a.join(b, (F.col("seq_a") == F.col("seq_b")) & (F.col("bin_a") == F.col("bin_b")) & (F.col("from_a") < F.col("region_end")) & (F.col("to_a") > F.col("region_start")))
    return pairs.filter(F.col("bin_a") == F.greatest(floor(F.col("from_a")), floor(F.col("region_start")))).select("read.*", "region_id", "region_start", "region_end")


def slice_statistics(reads: DataFrame, width: int = 1000) -> DataFrame:
    """An index over stretches of `width` starts: (sequence_id, slice, first, last, n_reads, max_span)."""
    end = F.col("start") + read_span()
    return reads.groupBy("sequence_id", F.floor(F.col("start") / width).cast("long").alias("slice")).agg(F.min("start").alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("n_reads"), F.max(read_span()).cast("long").alias("max_span"))


def coverage_depth(reads: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(sequence_id, pos, depth) where the depth of mapped reads changes.

    A running sum per sequence would put a chromosome into one task: changes are summed by bin of `width` positions first, and
    the running sums go over bins and then within each.
    """
    mapped = reads.filter("length_on_ref > 0")
    ends = mapped.select("sequence_id", F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("start") + F.col("length_on_ref")).cast("long").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("sequence_id", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).withColumn("bin", F.floor(F.col("pos") / width))
    bins = steps.groupBy("sequence_id", "bin").agg(F.sum("d").alias("bin_d")).withColumn("before", F.sum("bin_d").over(Window.partitionBy("sequence_id").orderBy("bin")) - F.col("bin_d"))
    run = F.sum("d").over(Window.partitionBy("sequence_id", "bin").orderBy("pos"))
    return steps.join(bins.drop("bin_d"), ["sequence_id", "bin"]).select("sequence_id", "pos", (F.col("before") + run).cast("long").alias("depth"))
