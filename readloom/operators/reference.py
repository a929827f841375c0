"""Reference sequences brought to reads, and what slices need of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.aligned import features_from_alignment
from readloom.functions.features import resolved
from readloom.functions.tags import reference_md5


def absolute_starts(rows: DataFrame, key: list[str], base: str = "slice_start_pos") -> DataFrame:
    """`start` from `start_delta`: sums along a slice's records, from the slice's own start `base`."""
    w = Window.partitionBy(*key).orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.col(base) + F.sum("start_delta").over(w))


def reference_spans(reads: DataFrame, key: list[str]) -> DataFrame:
    """(key, sequence_id, span_start, span_end): the reference that each slice's placed reads need of each sequence."""
    end = F.col("start") + F.coalesce("length_on_ref", "read_length")
    spans = reads.filter("sequence_id >= 0").groupBy(*key, "sequence_id").agg(F.min("start").alias("span_start"), F.max(end).alias("span_end"))
    return spans.filter("span_end > span_start")


def with_reference(reads: DataFrame, chunks: DataFrame, size: int, read_key: list[str], most: int = 1 << 24) -> DataFrame:
    """Mapped reads with `ref`, the reference under them, or null where the chunks do not cover it.

    chunks: (ref_id, chunk, seq) of `size` bases each (sources.reference_chunks without a margin). A read that lies on one chunk or two
    neighbours finds both in one row. Chunks of at most `most` bases in all (counted first) are sent to the tasks and reads stay where they
    are; a longer read has its sequence's chunks in one row then. Beyond that a read moves once, in an equality join on its sequence and first
    chunk, and longer ones go to each chunk that they touch and put the pieces together again, narrowed to their key and place for that.
    """
    end = F.col("start") + F.col("length_on_ref")
    chunks = chunks.select("ref_id", "chunk", "seq")
    small = chunks.select(F.lit(1)).limit(most // size + 1).count() <= most // size
    after = chunks.select("ref_id", (F.col("chunk") - 1).alias("chunk"), F.col("seq").alias("after_"))
    pairs = chunks.join(after, ["ref_id", "chunk"], "left").select(F.col("ref_id").alias("ref_id_"), F.col("chunk").alias("chunk_"), F.concat("seq", F.when(F.length("seq") == size, F.coalesce("after_", F.lit(""))).otherwise("")).alias("seq_"))
    first, last = F.floor(F.col("start") / size).cast("int"), F.floor((end - 1) / size).cast("int")
    far = last > first + 1
    near = reads.join(F.broadcast(pairs) if small else pairs, (F.col("sequence_id") == F.col("ref_id_")) & (first == F.col("chunk_")) & (F.col("length_on_ref") > 0) & ~far, "left")
    cut = F.substring(F.col("seq_"), (F.col("start") - F.col("chunk_").cast("long") * size).cast("int") + 1, F.col("length_on_ref"))
    near = near.withColumn("near_", F.when(F.length(cut) == F.col("length_on_ref"), cut)).drop("ref_id_", "chunk_", "seq_")
    if small:
        # all of a sequence up to its first gap or short chunk, as no read reaches beyond either, and all after a gap likewise
        w = Window.partitionBy("ref_id").orderBy("chunk")
        breaks = (F.lag("chunk").over(w) != F.col("chunk") - 1) | (F.lag(F.length("seq")).over(w) != size)
        marked = chunks.withColumn("new_", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("run_", F.sum("new_").over(w))
        runs = marked.groupBy("ref_id", "run_").agg(F.min("chunk").alias("low_"), F.max("chunk").alias("high_"), F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]).alias("seqs_"))
        runs = runs.select(F.col("ref_id").alias("ref_id_"), "low_", "high_", "seqs_")
        rows = near.join(F.broadcast(runs), (F.col("sequence_id") == F.col("ref_id_")) & far & (F.col("length_on_ref") > 0) & (first >= F.col("low_")) & (last <= F.col("high_")), "left")
        text = F.array_join(F.slice("seqs_", (first - F.col("low_") + 1).cast("int"), last - first + 1), "")
        cut = F.substring(text, (F.col("start") - first.cast("long") * size).cast("int") + 1, F.col("length_on_ref"))
        far_ref = F.when(F.col("seqs_").isNotNull(), F.when(F.length(cut) == F.col("length_on_ref"), cut))
        return rows.withColumn("ref", F.coalesce("near_", far_ref)).select(*reads.columns, "ref")

    mapped = reads.filter((F.col("length_on_ref") > 0) & far).select(*read_key, F.col("sequence_id").alias("ref_id"), "start", end.alias("end")).distinct()
    touched = mapped.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))))
    at = F.col("chunk").cast("long") * size
    part = F.substring(F.col("seq"), F.greatest(F.lit(0), F.col("start") - at).cast("int") + 1, (F.least(F.col("end") - at, F.lit(size)) - F.greatest(F.lit(0), F.col("start") - at)).cast("int"))
    pieces = touched.join(chunks, ["ref_id", "chunk"]).select(*read_key, "ref_id", "chunk", "start", "end", part.alias("part"))
    place = [*read_key, "sequence_id", "start", "length_on_ref"]  # rows of equal key may lie elsewhere
    pieces = pieces.withColumns({"sequence_id": F.col("ref_id"), "length_on_ref": F.col("end") - F.col("start")})
    whole = pieces.groupBy(*place).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("ref"))
    rows = near.join(whole.filter(F.length("ref") == F.col("length_on_ref")), place, "left").withColumn("ref", F.coalesce("near_", "ref"))
    return rows.select(*reads.columns, "ref")


def aligned_features(reads: DataFrame, chunks: DataFrame, size: int, read_key: list[str]) -> DataFrame:
    """Reads of a SAM source (cigar, read_bases, quals) with `ref` and with `features`, what sets them apart from the reference under them.

    A read whose reference the chunks do not cover stores its bases as stretches; one without a CIGAR has null features.
    """
    quals = F.col("quals") if "quals" in reads.columns else None
    made = features_from_alignment(F.col("cigar"), F.col("read_bases"), F.col("start"), F.col("ref"), F.col("start"), quals)
    return with_reference(reads, chunks, size, read_key).withColumn("features", made)


def resolve_features(reads: DataFrame, chunks: DataFrame, size: int, read_key: list[str], matrix: Column) -> DataFrame:
    """Reads with `ref`, and with ref and sub filled in for their features: X stands for what the substitution matrix says of its code (num),
    B for its own base; features that lie outside the reference known stay as they are. `read_bases` and `mismatches` work on the result.
    """
    rows = with_reference(reads, chunks, size, read_key)
    return rows.withColumn("features", resolved(F.col("features"), F.col("ref"), F.col("start"), matrix))


def reference_names(rows: DataFrame, refs: DataFrame, ref_id: str = "ref_id") -> DataFrame:
    """rows with `name`, their sequence's in refs (ref_id, name); null for an id that is null or not there."""
    return rows.join(refs.select(F.col("ref_id").alias("id_"), "name"), F.col(ref_id) == F.col("id_"), "left").drop("id_")


def check_checksums(slices: DataFrame) -> DataFrame:
    """Slices (md5, ref) with `md5_ok`; an all-zero or null checksum is not recorded and passes."""
    recorded = F.col("md5").isNotNull() & ~F.col("md5").rlike("^0*$")
    return slices.withColumn("md5_ok", F.when(recorded, reference_md5("ref") == F.col("md5")).otherwise(True))
