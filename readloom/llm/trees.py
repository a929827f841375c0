"""Sums of large vectors over all tasks, in a tree of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, block int, sums binary"


def _added(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for b in batches:
            for x in b.column("sums"):
                more = np.frombuffer(x.as_buffer(), dtype)
                total = more.copy() if total is None else total + more
            if first is None and b.num_rows:
                first = b.slice(0, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column("part"), first.column("block"), pa.array([total.tobytes()], pa.binary())], ["part", "block", "sums"])

    return run


def tree_summed(partials: DataFrame, dtype: str, fan: int = 16) -> DataFrame:
    """(part, block, sums) of one row a block: partial sums (part: any number of the task that made it) added in three levels.

    A task adds a `fan` squared-th of all partials of a block, the next level's a `fan`-th, the last the rest; each holds one block.
    """
    for level in (fan * fan, fan, 1):
        partials = partials.withColumn("part", F.pmod("part", F.lit(level)).cast("int")).groupBy("part", "block").applyInArrow(_added(dtype), SCHEMA)
    return partials
