"""FASTA text as rows and as chunks for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.flags import let


def fasta_records(records: DataFrame) -> DataFrame:
    """(name, seq) of FASTA records (value): a header line, with or without its `>`, and lines of sequence.

    The name ends at the first white space; white space within a sequence is dropped, a `>` within a header line stays.
    """
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    return records.filter(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of FASTA files; a record begins where a line begins with `>`."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def reference_chunks(sequences: DataFrame, size: int = 1 << 16, margin: int = 0) -> DataFrame:
    """(ref_id, chunk, chunk_start, seq) from (ref_id, seq): stretches of `size` bases, each with up to `margin` (at most `size`) bases more at its end.

    A sequence is cut in one pass; an empty one gives one empty chunk, a null one none.
    """
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    if margin:
        parts = let(parts, lambda a: F.transform(a, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(a, i + 1), F.lit("")), 1, margin))))
    chunks = sequences.filter("seq is not null").select("ref_id", F.posexplode(parts).alias("chunk", "seq"))
    return chunks.select("ref_id", "chunk", (F.col("chunk").cast("long") * size).alias("chunk_start"), "seq")
