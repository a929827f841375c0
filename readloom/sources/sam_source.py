"""SAM text as a Spark data source: `spark.read.format("sam-text")`, planned from byte ranges.

Without an index a file is read in blocks of bytes, a line belonging to the block in which it begins. With an index (`index_sam`) only
byte ranges that may hold what the filters ask for are planned: filters on `rname` and `start` reach the source where
spark.sql.python.filterPushdown.enabled is set (`load_sam` sees to it), and as options (`rname`, `start`, `end`) in any case. Columns are those of `COLUMNS`, or of
the option `columns`; only these are built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from readloom.model import MalformedInputError
from readloom.sources.files import after_line, files_at, opened
from readloom.sources.samtext import PARSED, fields

#: Bytes of a block, the least that is worth a task, and what a task parses at a time.
BLOCK, LEAST, STEP = 64 << 20, 4 << 20, 1 << 20

#: Where a line stands in its file, and its fields.
COLUMNS = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("line_bytes", T.IntegerType()), T.StructField("block", T.LongType()), *PARSED.fields])

#: Columns of a byte index: of each block and sequence, the places and bytes of its lines.
INDEX = ("file", "rname", "first_start", "last_end", "begin", "end", "n_reads")


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [begin, end); `block` is the size of the blocks in it, 0 if it is one."""

    file: str
    begin: int
    end: int
    block: int = 0


class SamSource(DataSource):
    """Options: path; index (a byte index's path), columns (names after commas), block_bytes, tasks (how many a read without an index has at least, if
    its files are not small), and rname, start, end to narrow the plan."""

    @classmethod
    def name(cls) -> str:
        return "sam-text"

    def schema(self) -> T.StructType:
        wanted = self.options.get("columns")
        return T.StructType([COLUMNS[c.strip()] for c in wanted.split(",")]) if wanted else COLUMNS

    def reader(self, schema: T.StructType) -> SamReader:
        kind = FilteringSamReader if self.options.get("push_filters") == "true" else SamReader
        return kind(dict(self.options), schema)


class SamReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.names = options, schema.fieldNames()
        number = lambda k: None if options.get(k) is None else int(options[k])
        self.rnames = [options["rname"]] if options.get("rname") is not None else None
        self.low, self.high = number("start"), number("end")

    def partitions(self) -> list[Range]:
        size = int(self.options.get("block_bytes", BLOCK))
        index = self.options.get("index")
        if index is None:
            files = files_at(self.options["path"])
            # a task takes as many blocks as make a fair share of the files, up to `BLOCK` bytes: small blocks are for an index, not a task each
            share = min(BLOCK, max(LEAST, sum(n for _, n in files) // int(self.options.get("tasks", 8))))
            step = max(1, share // size) * size
            return [Range(f, at, min(at + step, n), size) for f, n in files for at in range(0, n, step)] or [Range("", 0, 0)]
        import pyarrow.dataset as pads  # only the driver needs it

        system, at = opened(index)
        keep = pc.scalar(True)
        if self.rnames is not None:
            keep = keep & pc.field("rname").isin(pa.array(self.rnames, pa.string()))
        if self.high is not None:
            keep = keep & (pc.field("first_start") < self.high)
        if self.low is not None:
            keep = keep & (pc.field("last_end") > self.low)
        rows = pads.dataset(at, filesystem=system, format="parquet", exclude_invalid_files=False, ignore_prefixes=[".", "_"]).to_table(columns=["file", "begin", "end"], filter=keep)
        out: list[Range] = []
        for file, begin, end in sorted(zip(*(rows[c].to_pylist() for c in ("file", "begin", "end")), strict=True)):
            # ranges of two sequences may hold each other's lines; what touches is one range as long as it is no longer than a block
            if out and out[-1].file == file and begin < out[-1].end:
                out[-1].end = max(out[-1].end, end)
            elif out and out[-1].file == file and begin == out[-1].end and end - out[-1].begin <= size:
                out[-1].end = end
            else:
                out.append(Range(file, begin, end))
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.begin:
            return
        system, at = opened(part.file)
        with system.open_input_file(at) as f:
            begin = part.begin
            if begin:  # a line that begins before the range is another's
                begin = after_line(f, begin - 1)
            while begin < part.end:
                data = f.read_at(min(STEP, part.end - begin), begin)
                if not data:
                    return
                if not data.endswith(b"\n"):
                    cut = data.rfind(b"\n") + 1
                    data = data[:cut] if cut else f.read_at(after_line(f, begin) - begin, begin)
                yield from self._batch(part, begin, np.frombuffer(data, np.uint8))
                begin += len(data)

    def _batch(self, part: Range, offset: int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(data == 10)
        if not len(ends) or ends[-1] != len(data) - 1:
            ends = np.append(ends, len(data))
        starts = np.concatenate(([0], ends[:-1] + 1))
        whole = ends + 1 - starts
        size = ends - starts
        size -= (size > 0) & (data[ends - 1] == 13)
        some = (size > 0) & (data[starts] != ord("@"))
        starts, size, whole = starts[some], size[some], whole[some]
        if not len(starts):
            return
        rows = fields(data, starts, size, [c for c in self.names if c in PARSED.fieldNames()])
        own = {"file": lambda: pa.array([part.file] * len(starts)), "offset": lambda: pa.array(starts + offset), "line_bytes": lambda: pa.array(whole.astype(np.int32)), "block": lambda: pa.array((starts + offset) // part.block * part.block if part.block else np.full(len(starts), part.begin, np.int64))}
        yield pa.RecordBatch.from_arrays([own[c]() if c in own else rows.field(c) for c in self.names], self.names)


class FilteringSamReader(SamReader):
    """The reader that Spark hands its filters to; only sessions that push filters to Python sources may have it."""

    def pushFilters(self, filters):
        """Filters narrow the plan; Spark applies them all the same, as ranges hold other lines too."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rname",):
                self._named([f.value])
            elif isinstance(f, In) and f.attribute == ("rname",):
                self._named(list(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                at = f.value + isinstance(f, LessThanOrEqual)
                self.high = at if self.high is None else min(self.high, at)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("start",):
                # the option `start` asks for reads that reach beyond it, this for reads that begin there: the weaker one is kept
                self.low = f.value if self.low is None else max(self.low, f.value)
            yield f

    def _named(self, names: list[str]) -> None:
        self.rnames = names if self.rnames is None else [x for x in self.rnames if x in names]


def load_sam(spark: SparkSession, path: str, index: str | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """Lines of SAM files as `COLUMNS`; with an index and rname, start or end, from the byte ranges that may hold such reads."""
    spark.dataSource.register(SamSource)
    options |= {"path": path, "tasks": 2 * spark.sparkContext.defaultParallelism, "push_filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({"index": index} if index else {}) | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format("sam-text").options(**{k: str(v) for k, v in options.items()}).load()


def index_sam(spark: SparkSession, path: str, index: str, block_bytes: int = 1 << 20) -> None:
    """Writes a byte index of SAM files as Parquet at `index`: what each block holds of each sequence, and from which byte to which."""
    rows = load_sam(spark, path, columns=["file", "offset", "line_bytes", "block", "rname", "start", "reach"], block_bytes=block_bytes)
    reach = F.greatest(F.col("reach"), F.lit(1))
    found = rows.groupBy("file", "block", "rname").agg(
        F.min("start").alias("first_start"), F.max(F.col("start") + reach).alias("last_end"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("line_bytes")).alias("end"), F.count(F.lit(1)).alias("n_reads")
    )
    found.select(*INDEX).sort("rname", "first_start").write.mode("error").parquet(index)


def sam_range(spark: SparkSession, path: str, index: str, rname: str, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """Lines of reads on a sequence that lie in [start, end); only byte ranges that the index names are read."""
    if end <= start:
        raise ValueError(f"{MalformedInputError.__name__}: an empty range")
    names = columns or COLUMNS.fieldNames()
    need = [*names, *[c for c in ("rname", "start", "reach") if c not in names]]
    rows = load_sam(spark, path, index, need, rname=rname, start=start, end=end)
    return rows.filter((F.col("rname") == rname) & (F.col("start") < end) & (F.col("start") + F.greatest(F.col("reach"), F.lit(1)) > start)).select(*names)
