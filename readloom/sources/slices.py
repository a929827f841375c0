"""Reads in slices: files of neighbouring reads in order, and a stored index of what each file holds.

A range scan asks the index first and opens only the files that it names; within them row-group statistics and the filter do the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.intervals import read_span
from readloom.operators.ranges import range_join, range_query

#: Columns of the index: a row for each file and sequence in it; `span` reaches from the first start to the last end.
INDEX = ("file", "sequence_id", "start", "span", "max_span", "n_reads", "file_bytes")


def write_slices(reads: DataFrame, path: str, slice_reads: int = 100_000, partitions: int | None = None) -> None:
    """Writes reads (sequence_id, start, length_on_ref, more) as files of at most `slice_reads` neighbours, and the index beside them.

    Rows are dealt to ranges of (sequence, start, hash of the row), so a place where a third of all reads lie is still cut into several
    tasks and files (but for rows that are wholly equal); reads without a sequence or start go first. An empty table has an index without rows.
    """
    spark = reads.sparkSession
    plain = [F.col(f.name) for f in reads.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = reads.withColumn("salt_", F.xxhash64(*plain)).repartitionByRange(n, "sequence_id", "start", "salt_")
    salted.sortWithinPartitions("sequence_id", "start", "salt_").drop("salt_").write.mode("error").option("maxRecordsPerFile", slice_reads).parquet(f"{path}/reads")
    write_index(spark, path)


def write_index(spark: SparkSession, path: str) -> None:
    """The index of the files that lie there, made anew."""
    rows = spark.read.parquet(f"{path}/reads").select("sequence_id", "start", read_span().alias("reach"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"))
    found = rows.groupBy("file", "file_bytes", "sequence_id").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("reach")) - F.min("start")).alias("span"), F.max("reach").alias("max_span"), F.count(F.lit(1)).alias("n_reads"))
    found.select(*INDEX).sort("sequence_id", "start").write.mode("overwrite").parquet(f"{path}/index")


def slice_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _opened(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The rows of some of the files; with none named, no rows."""
    schema = spark.read.parquet(files[0] if files else f"{path}/reads").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_range(spark: SparkSession, path: str, sequence_id: int, start, end) -> DataFrame:
    """Reads on a sequence that lie in [start, end), from the files that the index names. The driver sees those files' names."""
    named = slice_index(spark, path).filter((F.col("sequence_id") == sequence_id) & (F.col("start") < end) & (F.col("start") + F.col("span") > start))
    return range_query(_opened(spark, path, [r["file"] for r in named.select("file").distinct().sort("file").collect()]), sequence_id, start, end)


def read_regions(spark: SparkSession, path: str, regions: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Every read with every region (region_id, sequence_id, region_start, region_end) that it lies in, from the files that the index names.

    Paths are listed one by one, which for many takes longer than reading them: where most files are named, the folder is opened instead.
    """
    index = slice_index(spark, path).select("file", "sequence_id", "start", F.col("span").cast("int").alias("length_on_ref"))
    named = range_join(index.filter("sequence_id is not null and start is not null"), regions, width).select("file").distinct()
    if 2 * named.count() > index.select("file").distinct().count():
        return range_join(spark.read.parquet(f"{path}/reads"), regions, width)
    return range_join(_opened(spark, path, [r["file"] for r in named.sort("file").collect()]), regions, width)
