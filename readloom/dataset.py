"""Alignments with their reference dictionary as one object: range queries by name or id."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import operators as O
from readloom.functions.bases import mismatch_rows
from readloom.model import ArgumentError
from readloom.sources.fasta_ranges import fasta_chunks, fasta_index
from readloom.sources.sam import read_header, read_sam, references


class AlignmentDataset:
    """Reads (see sources.sam.read_sam for their columns) and references (ref_id, name, length, md5); and, if they are known, the references' bases
    as chunks (ref_id, chunk, seq) of `chunk_size`.
    """

    def __init__(self, reads: DataFrame, refs: DataFrame, header: DataFrame | None = None, chunks: DataFrame | None = None, chunk_size: int = 1 << 16):
        self.reads, self.references, self.header, self.chunks, self.chunk_size = reads, refs, header, chunks, chunk_size

    @classmethod
    def from_sam(cls, spark: SparkSession, path: str) -> AlignmentDataset:
        header = read_header(spark, path)
        rows = read_sam(spark, path).withColumn("unique_id", F.concat_ws(":", "file", "rec_no"))
        return cls(rows, references(header), header)

    def with_fasta(self, path: str, chunk_size: int = 1 << 16) -> AlignmentDataset:
        """The same with the bases of its references, those of FASTA files by name; other records are not used."""
        spark = self.reads.sparkSession
        ids = self.references.groupBy("name").agg(F.min("ref_id").alias("ref_id"))
        records = fasta_index(spark, path).join(ids, "name").select("file", "record", "ref_id")
        chunks = fasta_chunks(spark, path, chunk_size).join(records, ["file", "record"]).select("ref_id", "chunk", "seq")
        return AlignmentDataset(self.reads, self.references, self.header, chunks, chunk_size)

    def reference_id(self, name: str) -> int:
        """Id of the first sequence of that name; an unknown one raises."""
        found = self.references.filter(F.col("name") == name).agg(F.min("ref_id")).first()[0]
        if found is None:
            raise ArgumentError(f"no reference sequence is called {name!r}")
        return found

    def reference_name(self, ref_id: int) -> str | None:
        row = self.references.filter(F.col("ref_id") == ref_id).select("name").head()
        return row[0] if row else None

    def has_data(self, sequence: str | int) -> bool:
        return not self.reads.filter(F.col("sequence_id") == self._id(sequence)).isEmpty()

    def _id(self, sequence: str | int) -> int:
        return self.reference_id(sequence) if isinstance(sequence, str) else sequence

    def range(self, sequence: str | int, start=0, end=float("inf")) -> DataFrame:
        """Reads in [start, end); sequence -1 and start -1 give unplaced reads."""
        return O.range_query(self.reads, self._id(sequence), start, end)

    def pairs(self, sequence: str | int, start=0, end=float("inf"), **how) -> DataFrame:
        """Reads in the range and their mates from elsewhere; see operators.view_as_pairs."""
        return O.view_as_pairs(self.reads, self._id(sequence), start, end, **how)

    def regions(self, regions: DataFrame) -> DataFrame:
        """Reads of each of many regions (region_id, sequence_id, region_start, region_end)."""
        return O.region_join(self.reads, regions)

    def features(self, reads: DataFrame | None = None, key: str = "unique_id") -> DataFrame:
        """Reads (all, or those given) with the reference under them and their features against it; `key` tells reads apart."""
        if self.chunks is None:
            raise ArgumentError("features need the references' bases: see with_fasta")
        return O.aligned_features(self.reads if reads is None else reads, self.chunks, self.chunk_size, [key])

    def mismatches(self, sequence: str | int, start=0, end=None, key: str = "unique_id", origin: int = 0) -> DataFrame:
        """Differences of the reads in a range that lie in it, a row each beside the read's key."""
        found = self.features(self.range(sequence, start, float("inf") if end is None else end), key).withColumn("ref_start", F.col("start"))
        return mismatch_rows(found, key, window_start=start, window_end=end, origin=origin)

    @cached_property
    def slices(self) -> DataFrame:
        """The reads' own index: stretches of starts with their extent and number of reads."""
        return O.slice_statistics(self.reads)
