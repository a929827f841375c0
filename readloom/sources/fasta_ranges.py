"""FASTA by byte ranges: a chromosome is never one row, nor in one task, whether its lines are wrapped or not.

Files are cut into blocks of bytes. First each block tells what begins in it: records, and how many bases each part of a record has there.
Whether a block begins within a header line follows from the last line end before it. Sums over the blocks of a file then give
each part its first base's place in its record. At last each block is read again and gives the chunks that begin in it, reading on into the
next blocks for the end of its last one. Only the blocks' few numbers are shuffled, never bases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.sources.files import after_line, files_at, opened

BLOCK = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(file, file_no, begin, end) of the files at a path, dealt to as many tasks as there are blocks."""
    files = [(f, k, size) for k, (f, size) in enumerate(files_at(path))]
    rows = spark.createDataFrame(files, "file string, file_no int, size long").filter("size > 0")
    rows = rows.select("file", "file_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("begin"), "size")
    n = sum(-(-size // block) for _, _, size in files)
    return rows.select("file", "file_no", "begin", F.least("size", F.col("begin") + block).alias("end")).repartition(max(1, n), "file_no", "begin")


def _parts(data: np.ndarray, at_line: bool) -> list[tuple[int, int, bool]]:
    """(from, to, whether a record begins): the stretches of sequence in a block, in order; the first goes on with the record before.

    A record's stretch begins behind the `>` of its header, the header with it, and is cut at the next header.
    """
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0] if at_line else [], ends + 1)).astype(np.int64)
    starts = starts[starts < len(data)]
    heads = starts[data[starts] == ord(">")]
    bounds = [*heads.tolist(), len(data)]
    return [(0, bounds[0], False), *((a, b, True) for a, b in zip(bounds, bounds[1:]))]


def _bases(data: np.ndarray, skip_line: bool) -> np.ndarray:
    """The bases of a stretch, without white space, and without its first line if that is (the rest of) a header."""
    if skip_line:
        ends = np.flatnonzero(data == 10)
        data = data[ends[0] + 1 :] if len(ends) else data[:0]
    return data[~_WHITE[data]]


def _read(file: str, begin: int, end: int) -> tuple[np.ndarray, bool]:
    """A block's bytes, and whether it begins with a line."""
    system, at = opened(file)
    with system.open_input_file(at) as f:
        data = f.read_at(end - max(0, begin - 1), max(0, begin - 1))
    return (np.frombuffer(data, np.uint8), True) if not begin else (np.frombuffer(data, np.uint8, offset=1), data[:1] == b"\n")


def fasta_layout(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, file_no, begin, end, in_header, parts): blocks in which parts array<struct<record, name, bases, base_at>> tells of each stretch which
    record it belongs to (from 0 in its file, -1 before the first), the name where the record begins, its bases, and how many come before them.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, begin, end in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data, at_line = _read(file, begin, end)
                parts = _parts(data, at_line)
                ends = np.flatnonzero(data == 10)
                last = int(ends[-1]) + 1 if len(ends) else None
                # whether the block ends within a header line: null where it holds neither a line end nor the start of a line
                open_ = None if last is None and not at_line else bool(len(data) > (last or 0) and data[last or 0] == ord(">"))
                sizes = [len(_bases(data[a:z], head)) for a, z, head in parts]
                out.append((open_, len(parts) - 1, sizes, len(_bases(data[: parts[0][1]], True)), [_name(file, begin + a) if head else None for a, _, head in parts]))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "open", "heads", "sizes", "first_in_header", "names"])

    blocks = _blocks(spark, path, block).mapInArrow(told, "file string, file_no int, begin long, end long, open boolean, heads long, sizes array<long>, first_in_header long, names array<string>")
    before = Window.partitionBy("file_no").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumns({"in_header": F.coalesce(F.last("open", ignorenulls=True).over(before), F.lit(False)), "record": F.coalesce(F.sum("heads").over(before), F.lit(0)) - 1})
    sizes = F.concat(F.array(F.when(F.col("in_header"), F.col("first_in_header")).otherwise(F.get("sizes", F.lit(0)))), F.slice("sizes", 2, F.size("sizes")))
    both = F.arrays_zip(sizes.alias("bases"), F.col("names").alias("name"))
    parts = rows.select("file", "file_no", "begin", "end", "in_header", "record", F.posexplode(both).alias("k", "x")).select("*", "x.*").drop("x")
    parts = parts.withColumn("record", F.col("record") + F.col("k"))
    along = Window.partitionBy("file_no", "record").orderBy("begin", "k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base_at", F.coalesce(F.sum("bases").over(along), F.lit(0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "record", "name", "bases", "base_at"))), lambda x: x.dropFields("k"))
    return parts.groupBy("file", "file_no", "begin", "end", "in_header").agg(ordered.alias("parts"))


def fasta_index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, record, name, length) of the records of FASTA files: how many bases each has."""
    parts = fasta_layout(spark, path, block).select("file", F.explode("parts").alias("p")).filter("p.record >= 0")
    return parts.groupBy("file", F.col("p.record").alias("record")).agg(F.max("p.name").alias("name"), F.sum("p.bases").alias("length"))


def fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16, margin: int = 0, block: int = BLOCK) -> DataFrame:
    """(file, record, chunk, chunk_start, seq): `reference_chunks` of the records of FASTA files, read by byte ranges.

    record counts from 0 in each file; a chunk has `size` bases and up to `margin` (at most `size`) more at its end. An empty record gives one
    empty chunk. What stands before a file's first header is passed over.
    """
    layout = fasta_layout(spark, path, block)
    n = max(1, sum(-(-s // block) for _, s in files_at(path)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, begin, end, in_header, parts in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                yield from _chunks_of(file, begin, end, in_header, parts, size, margin)

    names = "file string, record long, chunk int, chunk_start long, seq string"
    return layout.repartition(n, "file_no", "begin").mapInArrow(cut, names)


def _chunks_of(file: str, begin: int, end: int, in_header: bool, parts: list[dict], size: int, margin: int) -> Iterator[pa.RecordBatch]:
    data, at_line = _read(file, begin, end)
    system, at = opened(file)
    with system.open_input_file(at) as f:
        for (a, z, head), part in zip(_parts(data, at_line), parts, strict=True):
            record, base_at = part["record"], part["base_at"]
            if record < 0:
                continue
            whole = z < len(data)  # the record ends here
            bases = _bases(data[a:z], head or (in_header and a == 0))
            total = base_at + len(bases)
            first = -(-base_at // size)  # chunks that begin here: their first base lies in this stretch
            last = -(-total // size)
            empty = head and not len(bases)
            if last == first and not empty:
                continue
            if not whole:
                bases = np.concatenate((bases, _more(f, end, _within_header(data[a:z], head or (in_header and a == 0)), max(int(empty), last * size + margin - total))))
            if empty and len(bases):
                continue  # its bases begin in a later block
            rows = [(k, bases[k * size - base_at : (k + 1) * size + margin - base_at].tobytes().decode("latin-1")) for k in range(first, last)] or [(0, "")]
            for i in range(0, len(rows), 256):
                some = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(some)), pa.array([record] * len(some), pa.int64()), pa.array([k for k, _ in some], pa.int32()), pa.array([k * size for k, _ in some], pa.int64()), pa.array([s for _, s in some])],
                    ["file", "record", "chunk", "chunk_start", "seq"],
                )


def _within_header(data: np.ndarray, header_first: bool) -> bool:
    """Whether a stretch ends before its header line does."""
    return header_first and not (data == 10).any()


def _more(f, at: int, in_header: bool, wanted: int) -> np.ndarray:
    """Up to `wanted` more bases of a record that goes on at byte `at`."""
    out, got = [], 0
    if in_header:
        at = after_line(f, at)
    line = f.read_at(1, at - 1) == b"\n"
    while got < wanted and (raw := f.read_at(max(1 << 16, min(1 << 22, 2 * (wanted - got))), at)):
        data = np.frombuffer(raw, np.uint8)
        starts = np.concatenate(([0] if line else [], np.flatnonzero(data == 10) + 1)).astype(np.int64)
        starts = starts[starts < len(data)]
        heads = starts[data[starts] == ord(">")]
        bases = data[: heads[0]] if len(heads) else data
        out.append(bases[~_WHITE[bases]])
        got += len(out[-1])
        if len(heads):
            break
        at += len(data)
        line = raw.endswith(b"\n")
    return np.concatenate(out)[:wanted] if out else np.zeros(0, np.uint8)


def _name(file: str, at: int) -> str:
    """The name behind a header's `>`, up to the first white space."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        line = f.read_at(after_line(f, at) - at, at).decode("utf-8", "replace")[1:]
    return re.match(r"[^\s]*", line)[0]
