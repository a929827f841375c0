"""SAM text: header lines, the reference dictionary, alignment rows, and rows as text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.model import FLAGS
from readloom.sources.samtext import PARSED, line_parser, text_parts


def header_fields(line: Column) -> tuple[Column, Column]:
    """Tag and data (array<struct<tag, value>>) of a header line; a field without a colon is a tag with an empty value."""
    fields = F.split(line, "\t")
    pair = lambda f: F.when(F.instr(f, ":") > 0, F.struct(F.substring_index(f, ":", 1).alias("tag"), F.expr("''").alias("value"))).otherwise(F.struct(f.alias("tag"), F.lit("").alias("value")))
    rest = lambda f: F.when(F.instr(f, ":") > 0, F.regexp_extract(f, r"(?s)^[^:]*:(.*)$", 1)).otherwise("")
    return F.substring(F.get(fields, F.lit(0)), 2, 1 << 30), F.transform(F.slice(fields, 2, F.size(fields)), lambda f: F.struct(pair(f)["tag"].alias("tag"), rest(f).alias("value")))


def header_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, tag, data) of the header lines among (file, at, line); `at` orders a file's lines."""
    rows = lines.select("file", "at", F.regexp_replace("line", "\r$", "").alias("line")).filter(F.col("line").startswith("@"))
    tag, data = header_fields(F.col("line"))
    return rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("line_no"), tag.alias("tag"), data.alias("data"))


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, tag, data) of the header lines of SAM files."""
    return header_lines(_text_lines(spark, path))


def references(header: DataFrame) -> DataFrame:
    """(file, ref_id, name, length, md5): the @SQ lines in order; one without a name or length fails the job."""
    of = lambda t: F.get(F.filter("data", lambda d: d["tag"] == t), F.lit(0))["value"]
    need = lambda c: F.coalesce(c, F.raise_error(F.lit("an @SQ line lacks SN or LN")).cast("string"))
    rows = header.filter("tag = 'SQ'")
    return rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).alias("ref_id"), need(of("SN")).alias("name"), need(of("LN")).cast("long").alias("length"), of("M5").alias("md5"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM files; see `sam_rows`."""
    return sam_rows(_text_lines(spark, path), references(read_header(spark, path)))


def sam_rows(lines: DataFrame, refs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Alignment rows of SAM lines (file, at, line), with 0-based starts and ids by the order of @SQ lines, as refs (file, ref_id, name) has them.

    `*` is null; a reference of `*` is id -1; a mate reference of `=` is the read's own, of `*` unknown (null). Unmapped reads have no
    length_on_ref. Lines with under 11 fields fail the job. With `columns`, only these beside file and rec_no, and no more is built of a line.
    """
    need = tuple(c for c in PARSED.fieldNames() if columns is None or c in {x for y in columns for x in _FROM.get(y, [y])})
    refs = few(refs.groupBy("file", "name").agg(F.min("ref_id").alias("ref_id")))
    rows = lines.select("file", F.col("at").alias("rec_no"), line_parser(need)("line").alias("p")).filter("p is not null").select("file", "rec_no", "p.*")
    return with_reference_ids(rows, refs, columns)


#: The fields of a line that a column comes from, where it is not one of its own name.
_FROM = {"sequence_id": ["rname"], "length_on_ref": ["flags", "reach"], "read_length": ["read_bases"], "next_sequence_id": ["rnext", "rname"], "next_start": ["rnext", "rname", "pnext"]}


def few(refs: DataFrame, most: int = 1 << 17) -> DataFrame:
    """A reference dictionary as a table that is sent to the tasks, if it has at most `most` rows (they are fetched once); else as it is."""
    some = refs.limit(most + 1).toArrow()
    if some.num_rows > most:
        return refs
    return F.broadcast(refs.sparkSession.createDataFrame(some, refs.schema) if some.num_rows else refs.sparkSession.createDataFrame([], refs.schema))


def with_reference_ids(rows: DataFrame, refs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Alignment rows (or those columns of them) of parsed lines; refs (file, ref_id, name) with names told apart."""
    name = lambda key, as_: refs.select(F.col("file").alias("f_"), F.col("name").alias(key), F.col("ref_id").alias(as_))
    wanted = lambda *some: columns is None or any(c in columns for c in some)
    if wanted("sequence_id"):
        a = name("rname_", "sequence_id")
        rows = rows.join(a, (F.col("file") == a["f_"]) & (F.col("rname") == F.col("rname_")), "left").drop("f_", "rname_")
    if wanted("next_sequence_id", "next_start"):
        b = name("rnext_", "next_sequence_id")
        rnext = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
        rows = rows.join(b, (F.col("file") == b["f_"]) & (rnext == F.col("rnext_")), "left").drop("f_", "rnext_")
    unmapped = F.col("flags").bitwiseAND(F.lit(FLAGS["is_segment_unmapped"])) != 0
    made = {
        "sequence_id": F.coalesce("sequence_id", F.lit(-1)), "length_on_ref": F.when(~unmapped, F.col("reach")), "read_length": F.length("read_bases"), "next_start": F.when(F.col("next_sequence_id").isNotNull(), F.col("pnext")),
    }
    order = ["read_name", "flags", "sequence_id", "start", "length_on_ref", "read_length", "mapping_quality", "cigar", "next_sequence_id", "next_start", "template_length", "read_bases", "quals", "tags"]
    return rows.select("file", "rec_no", *[made.get(c, F.col(c)).alias(c) for c in order if wanted(c)])


def sam_lines(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, rec_no, line): alignment rows as SAM text; refs: (file, ref_id, name)."""
    refs = few(refs.select("file", "ref_id", "name"))
    name = lambda key, as_: refs.select(F.col("file").alias("f_"), F.col("ref_id").alias(key), F.col("name").alias(as_))
    a, b = name("id_", "rname"), name("next_", "mate_name")
    rows = rows.join(a, (F.col("file") == a["f_"]) & (F.col("sequence_id") == F.col("id_")), "left").drop("f_")
    rows = rows.join(b, (F.col("file") == b["f_"]) & (F.col("next_sequence_id") == F.col("next_")), "left").drop("f_")
    mate = F.when(F.col("mate_name").isNull(), "*").when(F.col("mate_name") == F.col("rname"), "=").otherwise(F.col("mate_name"))
    rows = rows.withColumn("text_", text_parts("cigar", "quals", "tags"))
    fixed = [
        F.coalesce("read_name", F.lit("*")), F.col("flags").cast("string"), F.coalesce("rname", F.lit("*")), (F.col("start") + 1).cast("string"), F.coalesce("mapping_quality", F.lit(0)).cast("string"), "text_.cigar",
        mate, F.coalesce(F.col("next_start") + 1, F.lit(0)).cast("string"), F.coalesce("template_length", F.lit(0)).cast("string"), F.coalesce("read_bases", F.lit("*")), "text_.quality",
    ]
    return rows.select("file", "rec_no", F.concat(F.concat_ws("\t", *fixed), F.coalesce("text_.tags", F.lit(""))).alias("line"))
