"""Slice index text: six integers in a line. Gzip is told by its first bytes, whatever the file is called."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.model import CRAI, MalformedInputError


def _lines(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        out = b""
        while data:
            d = zlib.decompressobj(31)
            out += d.decompress(data)
            data = d.unused_data
        data = out
    if data[:4] == b"BAI\x01":
        raise MalformedInputError("this is a BAI index, not a slice index")
    return data


def index_entries(lines: DataFrame) -> DataFrame:
    """(seq_id, start, span, container_start, slice_start, slice_bytes) of index lines (line), starts 0-based; equal lines stay.

    Blank lines, carriage returns and blanks are passed over; a line of other than six integers fails the job.
    """
    line = F.regexp_replace("line", "[\r ]", "")
    broken = F.raise_error(F.concat(F.lit(f"{MalformedInputError.__name__}: not a slice index line: "), F.substring(line, 1, 100)))
    parts = F.split(F.when(line.rlike(r"^[+-]?\d+(\t[+-]?\d+){5}$"), line).otherwise(broken.cast("string")), "\t")
    numbers = lines.filter(F.coalesce(line, F.lit("")) != "").select(parts.alias("n"))
    return numbers.select(*[(F.get("n", F.lit(k)).cast("long") - (1 if f.name == "start" else 0)).alias(f.name) for k, f in enumerate(CRAI.fields)])


def read_crai(spark: SparkSession, path: str) -> DataFrame:
    """The entries of index files, plain or gzip; see `index_entries`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_pydict({"line": pa.array(_lines(content).decode("ascii", "replace").split("\n"), pa.string())})

    return index_entries(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string"))


def entries_for_range(index: DataFrame, seq_id: int, start, end) -> DataFrame:
    """Index entries that overlap [start, end) of a sequence, in index order."""
    from readloom.functions import entry_overlaps

    return index.filter((F.col("seq_id") == seq_id) & entry_overlaps(start, end)).orderBy("start", "span")


def has_data(index: DataFrame, seq_id: int) -> bool:
    return not index.filter(F.col("seq_id") == seq_id).isEmpty()


def sequences_with_data(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (seq_id, ...) with has_data: whether the index has an entry of that sequence."""
    some = index.select("seq_id").distinct().withColumn("has_data", F.lit(True))
    return wanted.join(some, "seq_id", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def byte_estimate(index: DataFrame, seq_id: int, start, end) -> DataFrame:
    """(slices, total_bytes) that a range query would read."""
    return entries_for_range(index, seq_id, start, end).agg(F.count(F.lit(1)).alias("slices"), F.coalesce(F.sum("slice_bytes"), F.lit(0)).alias("total_bytes"))
