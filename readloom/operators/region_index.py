"""Many regions against reads: a sorted interval index that is sent to the tasks, where its size allows.

Regions are sorted by sequence and start. Over them stands a tree of fan-out `FAN`: each level holds the least start and the largest end of
its groups. A batch of reads goes down the tree together, each keeping only the groups that it can meet, so the work is the matches
plus a few groups a level, however long some regions are. Neither side is dealt to bins.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.flat import numbers
from readloom.functions.intervals import read_span
from readloom.operators.ranges import range_join

FAN = 16


class IntervalIndex:
    """Intervals [start, end) on sequences, none empty; asked for all that overlap each of many others."""

    def __init__(self, sequence: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.order = np.lexsort((start, sequence))
        sequence, start, end = sequence[self.order], start[self.order], end[self.order]
        self.names, first = np.unique(sequence, return_index=True)
        self.bounds = np.append(first, len(sequence))
        #: levels from the intervals up to the root; groups of a level never mix sequences, as each sequence has a tree of its own
        self.trees: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            levels = [(start[a:b], end[a:b])]
            while len(levels[-1][0]) > 1:
                at = np.arange(0, len(levels[-1][0]), FAN)
                levels.append((np.minimum.reduceat(levels[-1][0], at), np.maximum.reduceat(levels[-1][1], at)))
            self.trees.append(levels)

    def overlapping(self, sequence: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of those asked about, which interval) of every overlap, in order of both."""
        asked, found = [], []
        for name in np.intersect1d(np.unique(sequence), self.names):
            k = int(np.searchsorted(self.names, name))
            who = np.flatnonzero(sequence == name)
            node = np.zeros(len(who), np.int64)
            for level, (low, high) in enumerate(reversed(self.trees[k])):
                if level:
                    who, node = np.repeat(who, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = node < len(low)
                    who, node = who[inside], node[inside]
                stays = (low[node] < end[who]) & (high[node] > start[who])
                who, node = who[stays], node[stays]
            asked.append(who)
            found.append(self.order[self.bounds[k] + node])
        if not asked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, what = np.concatenate(asked), np.concatenate(found)
        order = np.lexsort((what, who))
        return who[order], what[order]


def fitting_width(reads: DataFrame, regions: DataFrame, least: int = 64) -> int:
    """The least power of two that neither side's mean span exceeds: a bin then holds few that do not meet, and on average no more than three bins
    hold an interval, however long some are."""
    region = regions.filter("region_end > region_start").agg(F.avg(F.col("region_end") - F.col("region_start"))).first()[0]
    read = reads.agg(F.avg(read_span())).first()[0]
    return 1 << (ceil(max(region or 1, read or 1, least)) - 1).bit_length()


def region_join(reads: DataFrame, regions: DataFrame, most: int = 1 << 18, width: int = 1 << 14) -> DataFrame:
    """The same rows as `range_join`: every read with every region (region_id, sequence_id, region_start, region_end) that it lies in.

    Up to `most` regions are an index in each task (24 bytes a region, and their rows in a broadcast join by number); more meet reads in
    bins of at most `width`, narrower where reads and regions are shorter. Reads without a sequence or start, and regions that are empty or hold a null, meet nothing; repeated rows meet each.
    """
    spark = reads.sparkSession
    regions = regions.select("region_id", "sequence_id", "region_start", "region_end")
    some = regions.filter("region_end > region_start and sequence_id is not null").limit(most + 1).toArrow()
    if some.num_rows > most:
        return range_join(reads, regions, min(width, fitting_width(reads, regions)))
    names = ("sequence_id", "region_start", "region_end")
    index = spark.sparkContext.broadcast(IntervalIndex(*(some[c].to_numpy().astype(np.int64) for c in names)))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def hits(sequence: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        known = np.flatnonzero(~(np.asarray(sequence.is_null()) | np.asarray(start.is_null())))
        who, what = index.value.overlapping(*(numbers(c)[known] for c in (sequence, start, end)))
        bounds = np.searchsorted(known[who], np.arange(len(sequence) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(what.astype(np.int32)))

    schema = T.StructType([*(regions.schema[c] for c in ("region_id", "region_start", "region_end")), T.StructField("hit_", T.IntegerType())])
    table = some.select(["region_id", "region_start", "region_end"]).append_column("hit_", pa.array(np.arange(some.num_rows, dtype=np.int32)))
    numbered = spark.createDataFrame(table, schema) if some.num_rows else spark.createDataFrame([], schema)
    start = F.col("start").cast("long")
    met = reads.select(F.struct(*reads.columns).alias("read"), F.explode(hits(F.col("sequence_id").cast("long"), start, start + read_span())).alias("hit_"))
    return met.join(F.broadcast(numbered), "hit_").select("read.*", "region_id", "region_start", "region_end")
