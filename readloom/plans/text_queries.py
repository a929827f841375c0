"""Queries over SAM text made of the driver's tables: features of aligned reads, slices with a stored index, the SAM data source.

`lineitem` gives reads with a CIGAR and bases on the nations' sequences of 256 bases: a clip, a substitution (or none), an insertion and a
deletion each in some of them. One text makes the columns for Spark and for the SQL twins.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom import functions as R
from readloom import operators as O
from readloom import sources as S

_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

#: A nation's sequence, and a read's parts on it (columns of lineitem and nation, `ref`).
_REF = f"translate(concat({', '.join(f"md5(concat(n_name, '{k}'))" for k in range(8))}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CLIP, _INSERTS, _GAP = "l_returnflag = 'R'", "l_linestatus = 'O'", "(case when l_linenumber % 2 = 0 then l_linenumber else 0 end)"
_START = "cast(l_partkey % 200 as int)"
_SUB = "substr('ACGT', cast(l_partkey % 4 as int) + 1, 1)"
_BASES = f"""concat(case when {_CLIP} then 'TTT' else '' end, substr(ref, {_START} + 1, 5), {_SUB}, substr(ref, {_START} + 7, 4), case when {_INSERTS} then 'GG' else '' end,
  substr(ref, {_START} + 11, 3), substr(ref, {_START} + 14 + {_GAP}, 6))"""
_CIGAR = f"concat(case when {_CLIP} then '5H3S' else '' end, case when l_linenumber = 3 then '5=1X4=' else '10M' end, case when {_INSERTS} then '2I' else '' end, '3M', case when {_GAP} > 0 then concat({_GAP}, 'D') else '' end, '6M')"
_PLAIN = f"""concat(case when {_CLIP} then '5H3S' else '' end, case when {_INSERTS} then concat('10M2I', case when {_GAP} > 0 then concat('3M', {_GAP}, 'D6M') else '9M' end)
  else case when {_GAP} > 0 then concat('13M', {_GAP}, 'D6M') else '19M' end end)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """SAM lines (file, at, line) of aligned reads, and the nations as references (file, ref_id, name, length, md5, seq)."""
    nation = _table(spark, d, "nation").select("n_nationkey", "n_name", F.expr(_REF).alias("ref"))
    rows = _table(spark, d, "lineitem").join(nation, F.col("l_suppkey") % 25 == F.col("n_nationkey"))
    lines = rows.select(F.lit("nations").alias("file"), F.concat_ws("-", *_KEYS).alias("at"), _line().alias("line"))
    header = nation.select(F.lit("nations").alias("file"), F.col("n_nationkey").cast("long").alias("at"), F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:256")).alias("line"))
    refs = S.references(S.header_lines(header))
    return lines, refs.join(nation.select(F.col("n_name").alias("name"), F.col("ref").alias("seq")), "name")


def _line() -> Column:
    """The SAM line of a row of lineitem beside its nation (n_name, ref)."""
    return F.concat_ws("\t", F.concat_ws("-", *_KEYS), F.lit("0"), "n_name", (F.expr(_START) + 1).cast("string"), F.lit("60"), F.expr(_CIGAR), F.lit("*"), F.lit("0"), F.lit("0"), F.expr(_BASES), F.lit("*"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Reads parsed from their lines, with features against the reference's chunks."""
    lines, refs = _lines(spark, d)
    reads = S.sam_rows(lines, refs.select("file", "ref_id", "name"), ["sequence_id", "start", "length_on_ref", "read_length", "cigar", "read_bases", "quals"]).withColumn("read", F.col("rec_no"))
    return O.aligned_features(reads, S.reference_chunks(refs.select("ref_id", "seq"), 64), 64, ["read"])


def aligned_round_trip(spark, d):
    """Reads' bases and CIGARs, made again from their features."""
    reads = _aligned(spark, d)
    cigar = R.cigar_string(R.cigar_from_features(F.col("features"), F.col("start"), F.col("read_length")))
    return reads.select("read", R.read_bases(F.col("features"), F.col("start"), F.col("read_length"), F.col("ref"), F.col("start")).alias("bases"), cigar.alias("cigar"))


def aligned_mismatches(spark, d):
    """Differences of aligned reads."""
    reads = _aligned(spark, d).withColumn("ref_start", F.col("start")).drop("quals")
    return R.mismatch_rows(reads, "read").fillna("", ["ref_base"]).drop("qual")


def aligned_substitutions(spark, d):
    """What stands in the place of each reference base, by the substitution's code."""
    x = F.explode(F.filter("features", lambda f: f["code"] == "X")).alias("x")
    return _aligned(spark, d).select(x).groupBy("x.ref", "x.sub", F.col("x.num").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, gone when the driver ends."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{shared}/readloom-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return path


def sliced_range(spark, d):
    """A range, from slices that the stored index names."""
    from readloom.plans.alignment_queries import alignments

    path = _scratch(spark)
    S.write_slices(alignments(spark, d), path, slice_reads=2000)
    return S.read_range(spark, path, 2, 2000, 4000).select(*_KEYS, "start", "length_on_ref", "flags")


def sliced_regions(spark, d):
    """Reads of many regions, from slices that the stored index names."""
    from readloom.plans.alignment_queries import alignments

    path = _scratch(spark)
    S.write_slices(alignments(spark, d), path, slice_reads=2000)
    regions = _table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 5).cast("int").alias("sequence_id"), (F.col("p_partkey") * 7).alias("region_start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("region_end"))
    return S.read_regions(spark, path, regions, 512).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("start").alias("first_start"))


def sam_source_range(spark, d):
    """A range of SAM files, from the byte ranges that their index names."""
    path = _scratch(spark)
    # rows are dealt to ranges as they are, and made lines there: neither the sample that bounds the ranges nor the shuffle has to have the lines
    nation = _table(spark, d, "nation").select("n_nationkey", "n_name", F.expr(_REF).alias("ref"))
    rows = _table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_returnflag", "l_linestatus").join(F.broadcast(nation.drop("ref")), F.col("l_suppkey") % 25 == F.col("n_nationkey"))
    dealt = rows.withColumn("at", F.expr(_START)).repartitionByRange("n_name", "at").join(F.broadcast(nation.drop("n_nationkey")), "n_name")
    dealt.select("n_name", "at", _line().alias("line")).sortWithinPartitions("n_name", "at", "line").select("line").write.text(f"{path}/sam")
    S.index_sam(spark, f"{path}/sam", f"{path}/index", block_bytes=1 << 16)
    found = S.sam_range(spark, f"{path}/sam", f"{path}/index", "CANADA", 50, 90, ["read_name", "start", "cigar", "read_bases"])
    return found.select(F.col("read_name").alias("read"), "start", R.cigar_string(F.col("cigar")).alias("cigar"), "read_bases")


def regions_by_index(spark, d):
    """Reads of every region, by a sorted interval index of the regions."""
    from readloom.plans.alignment_queries import alignments

    regions = _table(spark, d, "part").select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 5).cast("int").alias("sequence_id"), (F.col("p_partkey") * 7).alias("region_start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("region_end"))
    return O.region_join(alignments(spark, d), regions).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("start").alias("first_start"))


_SPAN_START, _SPAN_END = "cast(o_custkey % 90 as int)", "cast(o_custkey % 90 + o_orderkey % 150 as int)"


def slice_checksums(spark, d):
    """Checksums of slices of the nations' sequences, one for each order: right ones, wrong ones and some not recorded."""
    nation = _table(spark, d, "nation").select("n_nationkey", F.expr(_REF).alias("ref"))
    rows = _table(spark, d, "orders").join(nation, F.col("o_custkey") % 25 == F.col("n_nationkey"))
    md5 = F.expr(f"case when o_orderkey % 5 = 0 then '00000000000000000000000000000000' when o_orderkey % 3 = 0 then md5(o_orderstatus) else md5(substr(ref, {_SPAN_START} + 1, {_SPAN_END} - {_SPAN_START})) end")
    slices = rows.select("o_orderkey", F.col("n_nationkey").alias("ref_id"), F.expr(_SPAN_START).alias("span_start"), F.expr(_SPAN_END).alias("span_end"), md5.alias("md5"))
    chunks = S.reference_chunks(nation.select(F.col("n_nationkey").alias("ref_id"), F.lower("ref").alias("seq")), 32)
    return O.slice_checksums(slices, chunks, 32, ["o_orderkey"]).select("o_orderkey", "md5_ok")


def tags_by_type(spark, d):
    """Every user's tags as a variant, from events: whole numbers, reals, text and arrays, the last of a name by event id."""
    text = F.concat(F.substring("event_type", 1, 2), F.expr(_TAG))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"])
    tags = _table(spark, d, "events").groupBy("user_id").agg(R.tags_variant(fields).alias("tags"))
    one = lambda name, kind: R.variant_tag("tags", name, kind)
    return tags.select("user_id", F.size(R.variant_tags("tags")).alias("n_tags"), one("si", "bigint").alias("si"), one("cl", "double").alias("cl"), one("er", "string").alias("er"), F.element_at(one("pu", "array<bigint>"), 2).alias("pu"), R.variant_tag_type("tags", "pu").alias("pu_type"), one("zz", "string").alias("zz"))


#: The type and value of an event's tag.
_TAG = """case event_type when 'signup' then concat(':i:', event_id) when 'click' then concat(':f:', event_id % 100, '.5') when 'error' then concat(':Z:a"b:', event_id % 7) when 'purchase' then concat(':B:S,', user_id, ',', event_id % 9) else ':A:x' end"""


def mate_faults(spark, d):
    """Malformed mate pointers among an order's lines: cycles, second claims, pointers to nothing."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    reads = _table(spark, d, "lineitem").select("l_orderkey", n.alias("rec_no"))
    return O.mate_faults(reads.withColumn("mate_no", F.expr(_MATE)), ["l_orderkey"])


_MATE = """case l_orderkey % 4 when 0 then case rec_no when 1 then 2 when 2 then 3 when 3 then 1 end when 1 then case when rec_no in (1, 3) then 2 end
  when 2 then case rec_no when 1 then 2 when 2 then 99 end else case when rec_no % 2 = 1 then rec_no + 1 end end"""
_FAULTS = f"""with n as (select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as rec_no, cast(count(*) over (partition by l_orderkey) as int) as k from lineitem),
p as (select *, cast({_MATE} as int) as mate_no from n)
select l_orderkey, rec_no, mate_no, 'cyclic' as fault from p where l_orderkey % 4 = 0 and rec_no <= 3 and k >= 3
union all select l_orderkey, rec_no, mate_no, 'dangling' from p a where mate_no > k and exists (select 1 from p b where a.l_orderkey = b.l_orderkey and b.mate_no = a.rec_no)
union all select l_orderkey, rec_no, mate_no, 'claimed twice' from p where l_orderkey % 4 = 1 and mate_no = 2 and k >= 3"""

_ALL = f"reads as (select concat_ws('-', {', '.join(_KEYS)}) as read, n_name, {_START} as start, {_BASES} as bases, {_PLAIN} as plain, {_CIGAR} as cigar, {_SUB} as sub, ref, {_CLIP} as clips, {_INSERTS} as inserts, {_GAP} as gap from lineitem join (select n_nationkey, n_name, {_REF} as ref from nation) n on l_suppkey % 25 = n_nationkey)"
_X = "select read, 'X' as code, start + 5 as ref_pos, 1 as length, sub as bases, substr(ref, start + 6, 1) as ref_base, 0 as clip_length from reads where sub <> substr(ref, start + 6, 1)"

_SQL = {
    "aligned_round_trip": f"with {_ALL} select read, bases, plain as cigar from reads",
    "aligned_mismatches": f"""with {_ALL} {_X}
union all select read, 'H', start, 0, '', '', 5 from reads where clips union all select read, 'S', start, 0, '', '', 3 from reads where clips
union all select read, 'I', start + 10, 0, 'GG', '', 2 from reads where inserts union all select read, 'D', start + 13, cast(gap as int), '', '', 0 from reads where gap > 0""",
    "aligned_substitutions": f"with {_ALL}, x as ({_X}) select ref_base as ref, bases as sub, cast(instr(replace('ACGTN', ref_base, ''), bases) - 1 as int) as code, count(*) as n from x group by all",
    "mate_faults": _FAULTS,
    "tags_by_type": """with l as (select user_id, event_type, max(event_id) as e from events group by 1, 2)
select user_id, cast(count(*) as int) as n_tags, max(case when event_type = 'signup' then e end) as si, max(case when event_type = 'click' then e % 100 + 0.5::double end) as cl,
  max(case when event_type = 'error' then concat('a"b:', e % 7) end) as er, max(case when event_type = 'purchase' then e % 9 end) as pu, max(case when event_type = 'purchase' then 'BS' end) as pu_type, cast(null as varchar) as zz
from l group by user_id""",
    "slice_checksums": f"select o_orderkey, o_orderkey % 5 = 0 or {_SPAN_END} = {_SPAN_START} or o_orderkey % 3 <> 0 as md5_ok from orders",
    "sam_source_range": f"""with {_ALL} select read, start, cigar, bases as read_bases from reads where n_name = 'CANADA' and start < 90 and start + 19 + gap > 50""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (aligned_round_trip, aligned_mismatches, aligned_substitutions, sliced_range, sliced_regions, sam_source_range, regions_by_index, slice_checksums, mate_faults, tags_by_type)}


def oracle_sql() -> dict[str, str]:
    from readloom.plans.alignment_queries import _ALN, _SPAN
    from readloom.plans.alignment_queries import _SQL as older

    regions = f"with {_ALN} select p_partkey as region_id, count(*) as n_reads, min(start) as first_start from aln join part on sequence_id = p_partkey % 5 and start < p_partkey * 7 + p_size and start + {_SPAN} > p_partkey * 7 where p_size < 10 group by p_partkey"
    return _SQL | {"sliced_range": older["overlap_range"], "sliced_regions": regions, "regions_by_index": older["range_join"]}
