"""Queries that run the library's operators over whole driver tables, each with its twin in SQL.

`lineitem` serves as alignments: an order is a template, its lines are the template's reads, suppliers are dealt to five sequences.
`nation` gives reference sequences, `events` gives tags and index lines, `documents` gives checksums. What a query computes comes
from the library's functions; the SQL twins spell the same semantics out independently wherever SQL allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom import functions as R
from readloom import operators as O
from readloom import sources as S
from readloom.model import FLAGS, STORAGE_FLAGS
from readloom.plans import text_queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment-shaped view of lineitem; unmapped reads (line 7) have no length_on_ref."""
    unmapped = F.col("l_linenumber") == 7
    rows = _table(spark, sf_dir, "lineitem").select(
        *_KEY, F.col("l_orderkey").alias("read_name"), (F.col("l_suppkey") % 5).cast("int").alias("sequence_id"), (F.col("l_partkey") * 5 + F.col("l_linenumber")).cast("long").alias("start"),
        F.when(~unmapped, F.col("l_quantity").cast("int")).alias("length_on_ref"), F.col("l_quantity").cast("int").alias("read_length"),
        (1 + F.when(unmapped, 4).otherwise(0) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_linestatus") == "O", 32).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128)).cast("int").alias("flags"),
        F.concat_ws("-", *_KEY).alias("unique_id"),
    )
    w = Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumns({"next_sequence_id": F.lead("sequence_id").over(w), "next_start": F.lead("start").over(w)})


_ALN = """aln as (
  select *, lead(sequence_id) over w as next_sequence_id, lead(start) over w as next_start from (
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey as read_name, cast(l_suppkey % 5 as int) as sequence_id, cast(l_partkey * 5 + l_linenumber as bigint) as start,
      case when l_linenumber = 7 then null else cast(l_quantity as int) end as length_on_ref, cast(l_quantity as int) as read_length,
      cast(1 + case when l_linenumber = 7 then 4 else 0 end + case when l_returnflag = 'R' then 16 else 0 end + case when l_linestatus = 'O' then 32 else 0 end
        + case when l_linenumber % 2 = 1 then 64 else 128 end as int) as flags,
      concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as unique_id
    from lineitem) b
  window w as (partition by read_name order by l_linenumber, l_partkey, l_suppkey))"""

_SPAN = "coalesce(greatest(length_on_ref, 1), 1)"


def overlap_range(spark, d):
    return O.range_query(alignments(spark, d), 2, 2000, 4000).select(*_KEY, "start", "length_on_ref", "flags")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in a range, by pair orientation."""
    return O.range_query(alignments(spark, sf_dir), 2, 100, 900).groupBy(R.pair_orientation().alias("orientation")).agg(F.count(F.lit(1)).alias("n_reads"))


def flag_matrix(spark, d):
    return alignments(spark, d).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_reads"), *[F.count_if(R.flag(f)).alias(f) for f in FLAGS])


def pair_orientation(spark, d):
    return alignments(spark, d).groupBy(R.pair_orientation().alias("orientation"), R.has_next_position().alias("mate_known")).agg(F.count(F.lit(1)).alias("n_reads"))


def view_as_pairs(spark, d):
    return O.view_as_pairs(alignments(spark, d), 2, 2000, 4000, max_insert_size=3000).select("unique_id", "read_name", "start", "is_mate")


def view_as_pairs_across(spark, d):
    return O.view_as_pairs(alignments(spark, d), 1, 500, 1500, max_insert_size=2000, pair_across=True, strict_mates=True).select("unique_id", "read_name", "sequence_id", "start", "is_mate")


def range_join(spark, d):
    regions = _table(spark, d, "part").select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 5).cast("int").alias("sequence_id"), (F.col("p_partkey") * 7).alias("region_start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("region_end"))
    return O.range_join(alignments(spark, d), regions, 512).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("start").alias("first_start"))


def template_length(spark, d):
    a = alignments(spark, d).withColumn("rec_no", F.row_number().over(Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    a = a.withColumn("mate_no", F.when(F.col("rec_no") % 2 == 1, F.col("rec_no") + 1).otherwise(F.col("rec_no") - 1))
    return O.pair_template_lengths(a, "mate_no", ["read_name"]).select("unique_id", "template_length")


def mate_chain_lengths(spark, d):
    a = alignments(spark, d).withColumn("rec_no", F.row_number().over(Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    a = a.withColumn("mate_no", F.when((F.col("rec_no") % 4 != 0) & F.col("next_start").isNotNull(), F.col("rec_no") + 1))
    a = a.select("unique_id", "read_name", "rec_no", "mate_no", "start", "read_length")
    return O.chain_template_lengths(O.mate_chains(a, ["read_name"]), ["read_name"]).select("unique_id", "chain", "template_length")


def slice_index(spark, d):
    return O.slice_statistics(alignments(spark, d))


def slice_prune(spark, d):
    s = O.slice_statistics(alignments(spark, d)).withColumn("span", F.col("last") - F.col("first"))
    hit = s.filter((F.col("sequence_id") == 3) & R.entry_overlaps(4000, 6000, "first", "span"))
    return hit.agg(F.count(F.lit(1)).alias("slices"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("reads"), F.max("max_span").alias("max_span"))


def has_data(spark, d):
    """Of eight sequences, those that the reads' own index has entries of."""
    index = O.slice_statistics(alignments(spark, d)).withColumnRenamed("sequence_id", "seq_id")
    wanted = spark.range(8).select(F.col("id").cast("int").alias("seq_id"))
    return S.sequences_with_data(index, wanted).select(F.col("seq_id").alias("sequence_id"), "has_data")


def coverage_depth(spark, d):
    return O.coverage_depth(alignments(spark, d), 4096)


#: A CIGAR for every line, with clips, an insertion and a deletion.
_CIGAR_SQL = "concat(case when l_returnflag = 'R' then '5H4S' else '' end, cast(l_quantity as int), 'M', l_linenumber, 'I', cast(l_quantity as int), 'M', case when l_linenumber % 2 = 0 then concat(l_linenumber, 'D3M') else '' end, case when l_linestatus = 'O' then '6S' else '' end)"


def _cigars(spark, d) -> DataFrame:
    return _table(spark, d, "lineitem").select(*_KEY, F.expr(_CIGAR_SQL).alias("cigar")).withColumn("ops", R.parse_cigar("cigar"))


def cigar_spans(spark, d):
    return _cigars(spark, d).select(*_KEY, R.cigar_length_on_ref(F.col("ops")).alias("length_on_ref"), R.cigar_string(F.col("ops")).alias("cigar"))


def clip_lengths(spark, d):
    return _cigars(spark, d).select(*_KEY, R.leading_clip(F.col("ops")).alias("leading_clip"), R.trailing_clip(F.col("ops")).alias("trailing_clip"))


def packed_cigar(spark, d):
    return _cigars(spark, d).select(*_KEY, F.aggregate(R.packed_cigar(F.col("ops")), F.lit(0).cast("long"), lambda a, x: a * 31 % 1000003 + x).alias("packed_sum"), F.size("ops").alias("n_ops"))


def op_histogram(spark, d):
    return _cigars(spark, d).select(F.explode("ops").alias("o")).groupBy(F.col("o.op").alias("op")).agg(F.count(F.lit(1)).alias("n_ops"), F.sum("o.len").alias("bases"))


def _nation_refs(spark, d) -> DataFrame:
    """The nations' references (ref_id, ref) of 256 bases."""
    hexes = F.concat(*[F.md5(F.concat("n_name", F.lit(str(k)))) for k in range(8)])
    return _table(spark, d, "nation").select(F.col("n_nationkey").alias("ref_id"), F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT").alias("ref"))


def _featured(spark, d) -> DataFrame:
    """Reads of 20 bases with features, and their nation's reference of 256 bases."""
    refs = _nation_refs(spark, d)
    f = lambda code, pos, at, num, payload, sub: F.struct(F.lit(code).alias("code"), F.lit(pos).cast("int").alias("pos"), at.cast("int").alias("ref_pos"), num.cast("int").alias("num"), F.lit(payload).cast("string").alias("payload"), F.lit(None).cast("string").alias("ref"), sub.cast("string").alias("sub"))
    clip, ins, gap = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_linenumber") % 2 == 0
    start = (F.col("l_partkey") % 200).cast("int")
    c, n = F.when(clip, 3).otherwise(0), F.when(ins, 2).otherwise(0)
    sub = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("l_partkey") % 4 + 1).cast("int"))
    none = F.lit(None)
    features = F.filter(
        F.array(
            F.when(clip, f("S", 0, start, F.lit(3), "TTT", none)), F.struct(*[x for x in [F.lit("X").alias("code"), F.lit(5).alias("pos"), (start + 5 - c).cast("int").alias("ref_pos"), F.lit(0).alias("num"), none.cast("string").alias("payload"), none.cast("string").alias("ref"), sub.alias("sub")]]),
            F.when(ins, f("I", 9, start + 9 - c, F.lit(2), "GG", none)), F.when(gap, f("D", 13, start + 13 - c - n, F.col("l_linenumber"), None, none)),
        ),
        lambda x: x.isNotNull(),
    )
    rows = _table(spark, d, "lineitem").select(*_KEY, (F.col("l_suppkey") % 25).cast("int").alias("ref_id"), start.alias("start"), features.alias("features"))
    return rows.join(refs, "ref_id")


def feature_cigar(spark, d):
    return _featured(spark, d).select(*_KEY, R.cigar_string(R.cigar_from_features(F.col("features"), F.col("start"), F.lit(20))).alias("cigar"))


def read_bases(spark, d):
    return _featured(spark, d).select(*_KEY, R.read_bases(F.col("features"), F.col("start"), F.lit(20), F.col("ref"), F.lit(0)).alias("read_bases"))


def mismatches(spark, d):
    return R.mismatch_rows(_featured(spark, d).withColumn("ref_start", F.lit(0)), *_KEY).fillna("", ["ref_base"])


def mismatches_in_window(spark, d):
    found = _featured(spark, d).select("ref_id", F.explode(R.mismatches(F.col("features"), F.col("ref"), F.lit(0), window_start=50, window_end=120, origin=50)).alias("m"))
    return found.groupBy("ref_id", F.col("m.code").alias("code"), F.col("m.ref_pos").alias("ref_pos")).agg(F.count(F.lit(1)).alias("n"))


def tag_last_wins(spark, d):
    """Every user's tags: of an event type's values the last by event id."""
    e = _table(spark, d, "events")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))), lambda x: F.struct(x["event_type"].alias("key"), x["value"].alias("value")))
    return e.groupBy("user_id").agg(R.last_wins(entries).alias("m")).select("user_id", F.explode("m").alias("event_type", "value"))


def tags_map(spark, d):
    fields = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.substring("event_type", 1, 2), F.lit(":i:"), (F.col("event_id") % 1000).cast("string")).alias("t")))), lambda x: x["t"])
    rows = _table(spark, d, "events").groupBy("user_id").agg(R.parse_tags(fields).alias("tags"))
    return rows.select("user_id", F.size("tags").cast("long").alias("n_tags"), F.aggregate(F.map_values("tags"), F.lit(0).cast("long"), lambda a, x: a + x["i"]).alias("tag_sum"))


def reference_md5(spark, d):
    return _table(spark, d, "documents").select("doc_id", R.reference_md5("text").alias("md5"))


def block_crc32(spark, d):
    return _table(spark, d, "documents").select("doc_id", R.block_crc32("text").alias("crc32"))


def record_json(spark, d):
    a = alignments(spark, d).select("unique_id", R.to_json("start", "flags", "length_on_ref", "next_start").alias("j"))
    return a.select("unique_id", F.get_json_object("j", "$.start").cast("long").alias("start"), F.get_json_object("j", "$.length_on_ref").cast("int").alias("length_on_ref"), F.get_json_object("j", "$.next_start").cast("long").alias("next_start"))


def props_json(spark, d):
    return _table(spark, d, "events").select("event_id", R.json_field("props", "k").cast("long").alias("k"))


def quality_text(spark, d):
    q = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: 10 + (F.col("l_quantity").cast("int") + i) % 50)
    text = R.quality_string(q)
    return _table(spark, d, "lineitem").select(*_KEY, text.alias("quality"), F.aggregate(R.quality_bytes(text), F.lit(0), lambda a, x: a + x).alias("quality_sum"), R.quality_at(q, 0).alias("first_quality"))


def run_merge(spark, d):
    """Runs of equal event types of a user, merged as equal neighbours of a CIGAR are."""
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "S"), ("click", "C"), ("error", "E"), ("purchase", "P"), ("view", "V")) for x in pair])
    e = _table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("events"))
    ops = F.transform("events", lambda x: F.struct(kinds[x["event_type"]].alias("op"), F.lit(1).alias("len")))
    # a run's first event comes beside it, so no run has to carry all of its user's events
    heads = F.filter("events", lambda x, i: (i == 0) | ~kinds[x["event_type"]].eqNullSafe(kinds[F.get("events", i - 1)["event_type"]]))
    runs = e.select("user_id", F.explode(F.arrays_zip(heads.alias("head"), R.merge_cigar(ops).alias("run"))).alias("x"))
    return runs.select("user_id", F.col("x.head.event_type").alias("event_type"), F.col("x.head.event_id").alias("first_event"), F.col("x.run.len").cast("long").alias("n_events"))


def _nation_header(spark, d) -> DataFrame:
    """The header of a file whose sequences are the nations, as lines (file, at, line)."""
    line = F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), (F.col("n_nationkey") * 100 + 7).cast("string"), F.lit("\tM5:"), F.md5(F.col("n_name").cast("binary")))
    return _table(spark, d, "nation").select(F.lit("nations").alias("file"), F.col("n_nationkey").cast("long").alias("at"), line.alias("line"))


def reference_list(spark, d):
    """The reference dictionary of a header."""
    return S.references(S.header_lines(_nation_header(spark, d))).select(F.col("ref_id").cast("int").alias("ref_id"), "name", "length", "md5")


def reference_lookup(spark, d):
    """Sequences by id; ids are places in the header."""
    refs = S.references(S.header_lines(_nation_header(spark, d)))
    wanted = _table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 30).cast("int").alias("ref_id"))
    return O.reference_names(wanted, refs).select("s_suppkey", "ref_id", "name")


_SAM_SQL = """concat_ws('\t', case when l_linenumber = 3 then '*' else concat('r', l_orderkey) end, l_linenumber * 16, case when l_linenumber = 7 then '*' else concat('S', l_suppkey % 5) end, l_partkey + 1,
  l_linenumber * 8, concat(cast(l_quantity as int), 'M2I3D1S'), case when l_linenumber % 2 = 0 then '=' else concat('S', l_partkey % 5) end, l_suppkey + 1, cast(l_quantity as int) - 20, 'ACGTN', 'IIII#', concat('NM:i:', l_linenumber), 'XB:B:c,-1,2', concat('XZ:Z:', l_returnflag))"""


def _sam(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = _table(spark, d, "lineitem").select(F.lit("f").alias("file"), F.concat_ws("-", *_KEY).alias("at"), F.expr(_SAM_SQL.replace("\t", "\\t")).alias("line"))
    header = spark.range(5).select(F.lit("f").alias("file"), F.col("id").alias("at"), F.concat(F.lit("@SQ\tSN:S"), F.col("id").cast("string"), F.lit("\tLN:1000000")).alias("line"))
    return lines, S.references(S.header_lines(header))


def sam_reads(spark, d):
    """SAM lines made of lineitem, parsed."""
    rows = S.sam_rows(*_sam(spark, d))
    tag = lambda name, of: R.get_tag("tags", name)[of]
    return rows.select(
        F.col("rec_no").alias("read"), "read_name", "flags", "sequence_id", "start", "length_on_ref", "mapping_quality", "next_sequence_id", "next_start", "template_length", "read_bases", R.cigar_string(F.col("cigar")).alias("cigar"), F.get("quals", F.lit(4)).alias("last_quality"),
        tag("NM", "i").alias("nm"), tag("XZ", "s").alias("xz"), F.element_at(tag("XB", "ai"), 1).alias("xb"), tag("ZZ", "i").isNull().alias("no_tag"),
    )


def sam_text(spark, d):
    """The same lines, parsed and written again."""
    lines, refs = _sam(spark, d)
    return S.sam_lines(S.sam_rows(lines, refs), refs).select(F.col("rec_no").alias("read"), "line")


def fasta_sequences(spark, d):
    """FASTA records made of nations: a `>` in the header line, sequences over several lines."""
    value = F.concat(F.lit(">"), "n_name", F.lit(" of x->y\r\n"), F.md5(F.col("n_name").cast("binary")), F.lit("\nACGT \r\n"), F.md5(F.reverse("n_name").cast("binary")), F.lit("\n"))
    return S.fasta_records(_table(spark, d, "nation").select(value.alias("value")))


def _index_lines(spark, d) -> DataFrame:
    line = F.concat_ws("\t", F.col("user_id") % 7 - 1, F.col("event_id") + 1, F.col("event_id") % 50, F.col("event_id") * 3, F.lit("7"), (F.col("event_id") % 900 + 1).cast("string"))
    return _table(spark, d, "events").select(F.concat(line, F.when(F.col("event_id") % 2 == 0, "\r").otherwise("")).alias("line"))


def index_entries(spark, d):
    """Index lines made of events, parsed."""
    return S.index_entries(_index_lines(spark, d))


def index_estimate(spark, d):
    """What range queries would read, by the index."""
    index = S.index_entries(_index_lines(spark, d))
    found = [S.byte_estimate(index, k, 100, 700).withColumn("seq_id", F.lit(k)) for k in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def index_in_order(spark, d):
    """Entries of a range in index order."""
    found = S.entries_for_range(S.index_entries(_index_lines(spark, d)), 2, 0, float("inf"))
    return found.select("start", "span", "slice_bytes")


def storage_flags(spark, d):
    flags = (F.col("l_linenumber") * 3 % 16).cast("int")
    return _table(spark, d, "lineitem").groupBy("l_linenumber").agg(*[F.count_if(R.storage_flag(f, flags)).alias(f) for f in STORAGE_FLAGS])


def substitutions(spark, d):
    """What substitution codes stand for, by reference base."""
    base = F.element_at(F.array(*[F.lit(x) for x in "ACGTNacx"]), (F.col("l_partkey") % 8 + 1).cast("int"))
    matrix = F.array(F.lit(0b00011011), F.lit(0b11100100), F.lit(0b01001110), F.lit(0b10110001), F.lit(0b00011011))
    return _table(spark, d, "lineitem").select(*_KEY, R.substitution(matrix, base, (F.col("l_suppkey") % 4).cast("int")).alias("base"))


def merged_cigar(spark, d):
    """CIGARs with neighbours of one kind, and ops of length 0, made plain."""
    text = "concat(cast(l_quantity as int), 'M', l_linenumber, 'M', l_linenumber % 2, 'I1I', l_linenumber % 2, 'D2I7M')"
    return _table(spark, d, "lineitem").select(*_KEY, R.cigar_string(R.merge_cigar(R.parse_cigar(F.expr(text)))).alias("cigar"))


def detached_mates(spark, d):
    """Flags and places of mates as reads store them themselves."""
    a = alignments(spark, d)
    flags, seq, at = R.detached_mate("flags", (F.col("l_partkey") % 4).cast("int"), F.when(F.col("l_suppkey") % 3 == 0, -1).otherwise(F.col("sequence_id")), "start")
    return a.select("unique_id", flags.alias("flags"), seq.alias("next_sequence_id"), at.alias("next_start"))


def stored_bases(spark, d):
    """Differences of reads that store bases: B with a quality, b as a stretch, i one by one, N and H."""
    f = lambda code, pos, at, num, payload: F.struct(F.lit(code).alias("code"), F.lit(pos).cast("int").alias("pos"), at.cast("int").alias("ref_pos"), F.lit(num).cast("int").alias("num"), F.lit(payload).cast("string").alias("payload"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("sub"))
    at = F.col("start")
    features = F.array(f("H", 0, at, 4, None), f("B", 1, at + 1, 33, "A"), f("i", 3, at + 3, None, "C"), f("i", 4, at + 3, None, "G"), f("b", 6, at + 4, 3, "ACG"), f("N", 10, at + 8, 12, None), f("Q", 11, at + 20, 9, None))
    found = _featured(spark, d).select(*_KEY, F.explode(R.mismatches(features, F.col("ref"), F.lit(0), quals=F.sequence(F.lit(30), F.lit(49)))).alias("m"))
    return found.select(*_KEY, "m.*").fillna("", ["ref_base"])


def resolved_features(spark, d):
    """Features with their reference base and what they stand for, from chunks of the reference."""
    reads = _featured(spark, d)
    chunks = S.reference_chunks(_nation_refs(spark, d).withColumnRenamed("ref", "seq"), 64)
    one = F.transform("features", lambda x: x.withField("num", F.when(x["code"] == "X", F.lit(2)).otherwise(x["num"])))
    rows = reads.select(*_KEY, F.col("ref_id").alias("sequence_id"), "start", R.length_on_ref(F.col("features"), F.lit(20)).alias("length_on_ref"), one.alias("features"))
    done = O.resolve_features(rows, chunks, 64, _KEY, F.array(*[F.lit(0b00011011)] * 5))
    x = F.get(F.filter("features", lambda f: f["code"] == "X"), F.lit(0))
    return done.select(*_KEY, x["ref"].alias("ref_base"), x["sub"].alias("base"))


def pairs_by_index(spark, d):
    """Reads and mates, by a stored index and reads that carry their slice."""
    a = alignments(spark, d).withColumn("slice", F.floor(F.col("start") / 1000).cast("long"))
    return O.view_as_pairs(a, 2, 2000, 4000, max_insert_size=3000, index=O.slice_statistics(a), slice_column="slice").select("unique_id", "read_name", "start", "is_mate", "slice")


def header_tokens(spark, d):
    """Header lines made of customers, tokenized."""
    from readloom.sources.sam import header_fields

    line = F.concat(F.lit("@SQ\tSN:"), "c_name", F.lit("\tLN:"), F.col("c_custkey").cast("string"), F.lit("\t"), "c_mktsegment")
    tag, data = header_fields(line)
    return _table(spark, d, "customer").select("c_custkey", tag.alias("tag"), F.concat_ws("|", F.transform(data, lambda x: F.concat(x["tag"], F.lit("="), x["value"]))).alias("fields"))


def unplaced_reads(spark, d):
    a = alignments(spark, d).withColumns({"start": F.when(R.flag("is_segment_unmapped"), -1).otherwise(F.col("start")), "sequence_id": F.when(R.flag("is_segment_unmapped"), -1).otherwise(F.col("sequence_id"))})
    return O.range_query(a, -1, -1, float("inf")).select("unique_id", "start")


def placed_features(spark, d):
    """Feature positions worked out again from read positions, and the reference length of each read."""
    f = _featured(spark, d).withColumn("placed", R.place_features(F.col("features"), F.col("start")))
    return f.select(*_KEY, R.length_on_ref(F.col("features"), F.lit(20)).alias("length_on_ref"), F.aggregate("placed", F.lit(0), lambda a, x: a * 3 % 100003 + x["ref_pos"]).alias("ref_pos_sum"))


def reference_join(spark, d):
    """The reference under every read, put together from chunks of 64 bases."""
    reads = _featured(spark, d)
    refs = _nation_refs(spark, d).withColumnRenamed("ref", "seq")
    rows = reads.select(*_KEY, F.col("ref_id").alias("sequence_id"), "start", R.length_on_ref(F.col("features"), F.lit(20)).alias("length_on_ref"))
    return O.with_reference(rows, S.reference_chunks(refs, 64), 64, _KEY).select(*_KEY, F.col("ref").alias("ref_bases"))


def reference_spans(spark, d):
    return O.reference_spans(alignments(spark, d).withColumn("slice", F.floor(F.col("start") / 1000)), ["slice"]).select("slice", "sequence_id", "span_start", "span_end")


def delta_starts(spark, d):
    w = Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = alignments(spark, d).withColumns({"rec_no": F.row_number().over(w), "start_delta": F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(100)), "slice_start_pos": F.lit(100)})
    return O.absolute_starts(a.drop("start"), ["read_name"]).select("unique_id", "start")


def mate_association(spark, d):
    w = Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = alignments(spark, d).withColumns({"rec_no": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("read_name"))})
    a = a.withColumns({"mate_no": F.when((F.col("rec_no") % 3 != 0) & (F.col("rec_no") < F.col("n")), F.col("rec_no") + 1), "next_sequence_id": F.lit(None).cast("int"), "next_start": F.lit(None).cast("long"), "flags": F.col("flags").bitwiseAND(F.lit(-2))})
    return O.associate_mates(a, ["read_name"]).select("unique_id", "flags", "next_sequence_id", "next_start")


def lossy_names(spark, d):
    w = Window.partitionBy("read_name").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    a = alignments(spark, d).withColumns({"rec_no": F.row_number().over(w), "slice": F.col("read_name"), "n": F.count(F.lit(1)).over(Window.partitionBy("read_name"))})
    a = a.withColumns({"mate_no": F.when((F.col("rec_no") % 3 != 0) & (F.col("rec_no") < F.col("n")), F.col("rec_no") + 1), "read_name": F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("n"), F.col("l_partkey").cast("string")))})
    a = a.select("unique_id", "slice", "rec_no", "mate_no", "read_name")
    return O.propagate_names(O.mate_chains(a, ["slice"]), ["slice"]).select("unique_id", "read_name")


_FEAT = """feat as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_suppkey % 25 as int) as ref_id, cast(l_partkey % 200 as int) as start, case when l_returnflag = 'R' then 3 else 0 end as c,
    case when l_linestatus = 'O' then 2 else 0 end as n, case when l_linenumber % 2 = 0 then l_linenumber else 0 end as gap, substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) as sub from lineitem),
refs as (
  select n_nationkey as ref_id, translate(concat(md5(n_name || '0'), md5(n_name || '1'), md5(n_name || '2'), md5(n_name || '3'), md5(n_name || '4'), md5(n_name || '5'), md5(n_name || '6'), md5(n_name || '7')), '0123456789abcdef', 'ACGTACGTACGTACGT') as ref from nation)"""
_DIFFS = """diffs as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, ref_id, 'S' as code, start as ref_pos, 0 as length, '' as bases, -1 as qual, '' as ref_base, 3 as clip_length from feat where c > 0
  union all select l_orderkey, l_partkey, l_suppkey, l_linenumber, feat.ref_id, 'X', start + 5 - c, 1, sub, -1, substr(ref, start + 5 - c + 1, 1), 0 from feat join refs on feat.ref_id = refs.ref_id
  union all select l_orderkey, l_partkey, l_suppkey, l_linenumber, ref_id, 'I', start + 9 - c, 0, 'GG', -1, '', 2 from feat where n > 0
  union all select l_orderkey, l_partkey, l_suppkey, l_linenumber, ref_id, 'D', start + 13 - c - n, gap, '', -1, '', 0 from feat where gap > 0)"""
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_NUMBERED = f"num as (select *, row_number() over (partition by read_name order by l_linenumber, l_partkey, l_suppkey) as rec_no from aln)"
_ORIENT = """case when (flags & 1) <> 0 then list_extract(['F1F2','F1R2','R1F2','R1R2','F2F1','F2R1','R2F1','R2R1','F2F1','R2F1','F2R1','R2R1','F1F2','R1F2','F1R2','R1R2'],
  (((flags >> 4) & 7) | case when case when next_sequence_id is null then (flags & 64) <> 0 when sequence_id <> next_sequence_id then sequence_id < next_sequence_id when start <> next_start then start < next_start else (flags & 64) <> 0 end then 8 else 0 end) + 1) end"""


def _pairs_sql(seq: int, lo: int, hi: int, most: int, across: bool, strict: bool) -> str:
    return f"""with {_ALN},
hits as (select * from aln where sequence_id = {seq} and start < {hi} and start + {_SPAN} > {lo}),
single as (select read_name from hits group by read_name having count(*) = 1),
wanted as (select * from hits where read_name in (from single) and next_sequence_id is not null and abs(start - next_start) < {most}{'' if across else f' and next_sequence_id = {seq}'}),
stats as (select sequence_id, start // 1000 as slice, min(start) as first, max(start + {_SPAN}) as last from aln group by all),
slices as (select distinct s.sequence_id, slice from stats s join wanted w on s.sequence_id = w.next_sequence_id and first <= w.next_start and last > w.next_start),
mates as (select a.* from aln a join slices s on a.sequence_id = s.sequence_id and a.start // 1000 = s.slice where read_name in (from single) and unique_id not in (select unique_id from hits)
  {"and (read_name, a.sequence_id, start) in (select (read_name, next_sequence_id, next_start) from wanted)" if strict else ""})
select unique_id, read_name, {"sequence_id, " if across else ""}start, false as is_mate from hits union all select unique_id, read_name, {"sequence_id, " if across else ""}start, true from mates"""


_SQL = {
    "overlap_range": f"with {_ALN} select {_KEYS}, start, length_on_ref, flags from aln where sequence_id = 2 and start < 4000 and start + {_SPAN} > 2000",
    "pairs_in_range": f"with {_ALN} select {_ORIENT} as orientation, count(*) as n_reads from aln where sequence_id = 2 and start < 900 and start + {_SPAN} > 100 group by 1",
    "flag_matrix": f"with {_ALN} select sequence_id, count(*) as n_reads, {', '.join(f'cast(count_if((flags & {v}) <> 0) as bigint) as {k}' for k, v in FLAGS.items())} from aln group by sequence_id",
    "pair_orientation": f"with {_ALN} select {_ORIENT} as orientation, next_sequence_id is not null as mate_known, count(*) as n_reads from aln group by 1, 2",
    "view_as_pairs": _pairs_sql(2, 2000, 4000, 3000, False, False),
    "view_as_pairs_across": _pairs_sql(1, 500, 1500, 2000, True, True),
    "range_join": f"with {_ALN} select p_partkey as region_id, count(*) as n_reads, min(start) as first_start from aln join part on sequence_id = p_partkey % 5 and start < p_partkey * 7 + p_size and start + {_SPAN} > p_partkey * 7 group by p_partkey",
    "template_length": f"""with {_ALN}, {_NUMBERED} select a.unique_id, cast(case when a.start <= b.start then 1 else -1 end * (greatest(a.start + a.read_length, b.start + b.read_length) - least(a.start, b.start)) as bigint) as template_length
from num a join num b on a.read_name = b.read_name and b.rec_no = case when a.rec_no % 2 = 1 then a.rec_no + 1 else a.rec_no - 1 end""",
    "mate_chain_lengths": f"""with {_ALN}, {_NUMBERED}, c as (select *, cast((rec_no - 1) // 4 * 4 + 1 as int) as chain from num),
t as (select *, min(start) over w as lo, max(start + read_length) over w as hi, count(*) over w as k from c window w as (partition by read_name, chain))
select unique_id, chain, cast(case when k > 1 then case when start = lo then hi - lo else lo - hi end end as bigint) as template_length from t""",
    "slice_index": f"with {_ALN} select sequence_id, start // 1000 as slice, min(start) as first, max(start + {_SPAN}) as last, count(*) as n_reads, cast(max({_SPAN}) as bigint) as max_span from aln group by 1, 2",
    "slice_prune": f"""with {_ALN}, s as (select sequence_id, start // 1000 as slice, min(start) as first, max(start + {_SPAN}) as last, count(*) as n, cast(max({_SPAN}) as bigint) as max_span from aln group by 1, 2)
select count(*) as slices, cast(coalesce(sum(n), 0) as bigint) as reads, max(max_span) as max_span from s where sequence_id = 3 and first < 6000 and last > 4000""",
    "has_data": f"with {_ALN} select cast(range as int) as sequence_id, range in (select sequence_id from aln) as has_data from range(8)",
    "coverage_depth": f"""with {_ALN}, e as (select sequence_id, start as pos, 1 as d from aln where length_on_ref > 0 union all select sequence_id, start + length_on_ref, -1 from aln where length_on_ref > 0),
s as (select sequence_id, pos, sum(d) as d from e group by 1, 2) select sequence_id, pos, cast(sum(d) over (partition by sequence_id order by pos) as bigint) as depth from s""",
    "cigar_spans": f"select {_KEYS}, cast(2 * cast(l_quantity as int) + case when l_linenumber % 2 = 0 then l_linenumber + 3 else 0 end as int) as length_on_ref, {_CIGAR_SQL} as cigar from lineitem",
    "clip_lengths": f"select {_KEYS}, case when l_returnflag = 'R' then 5 else 0 end as leading_clip, case when l_linestatus = 'O' then 6 else 0 end as trailing_clip from lineitem",
    "packed_cigar": f"""with c as (select {_KEYS}, {_CIGAR_SQL} as cigar from lineitem),
o as (select {_KEYS}, list_transform(list_zip(regexp_extract_all(cigar, '([0-9]+)[A-Z]', 1), regexp_extract_all(cigar, '[0-9]+([A-Z])', 1)), lambda z: cast(z[1] as bigint) * 16 + instr('MIDNSHP=X', z[2]) - 1) as p from c)
select {_KEYS}, list_reduce(list_prepend(cast(0 as bigint), p), lambda a, x: a * 31 % 1000003 + x) as packed_sum, cast(len(p) as int) as n_ops from o""",
    "op_histogram": f"""with c as (select {_CIGAR_SQL} as cigar from lineitem), o as (select unnest(regexp_extract_all(cigar, '[0-9]+[A-Z]')) as t from c)
select right(t, 1) as op, count(*) as n_ops, cast(sum(cast(left(t, len(t) - 1) as bigint)) as bigint) as bases from o group by 1""",
    "feature_cigar": f"""with {_FEAT} select {_KEYS}, concat(case when c > 0 then '3S' else '' end, case when n > 0 then concat(9 - c, 'M2I', 4 - n, 'M') else concat(13 - c, 'M') end, gap, 'D7M') as cigar from feat where gap > 0
union all select {_KEYS}, concat(case when c > 0 then '3S' else '' end, case when n > 0 then concat(9 - c, 'M2I9M') else concat(20 - c, 'M') end) from feat where gap = 0""",
    "read_bases": f"""with {_FEAT} select {_KEYS}, concat(case when c > 0 then 'TTT' else '' end, substr(ref, start + 1, 5 - c), sub, substr(ref, start + 6 - c + 1, 3), case when n > 0 then 'GG' else '' end, substr(ref, start + 9 - c + 1, 4 - n), substr(ref, start + 13 - c - n + gap + 1, 7)) as read_bases
from feat join refs on feat.ref_id = refs.ref_id""",
    "mismatches": f"with {_FEAT}, {_DIFFS} select {_KEYS}, code, cast(ref_pos as int) as ref_pos, cast(length as int) as length, bases, qual, ref_base, clip_length from diffs",
    "mismatches_in_window": f"with {_FEAT}, {_DIFFS} select ref_id, code, cast(ref_pos - 50 as int) as ref_pos, count(*) as n from diffs where case when code = 'D' then ref_pos < 120 and ref_pos + length > 50 else ref_pos >= 50 and ref_pos < 120 end group by all",
    "placed_features": f"""with {_FEAT}, p as (select *, list_concat(case when c > 0 then [start] else [] end, [start + 5 - c], case when n > 0 then [start + 9 - c] else [] end, case when gap > 0 then [start + 13 - c - n] else [] end) as places from feat)
select {_KEYS}, cast(20 - c - n + gap as int) as length_on_ref, cast(list_reduce(list_prepend(0, places), lambda a, x: a * 3 % 100003 + x) as int) as ref_pos_sum from p""",
    "reference_join": f"with {_FEAT} select {_KEYS}, substr(ref, start + 1, 20 - c - n + gap) as ref_bases from feat join refs on feat.ref_id = refs.ref_id",
    "reference_spans": f"with {_ALN} select start // 1000 as slice, sequence_id, min(start) as span_start, max(start + coalesce(length_on_ref, read_length)) as span_end from aln group by 1, 2",
    "delta_starts": f"with {_ALN} select unique_id, start from aln",
    "mate_association": f"""with {_ALN}, {_NUMBERED}, k as (select unique_id, flags - 1 as f, sequence_id, start, rec_no % 3 <> 0 and lead(start) over w is not null as ahead, lag(rec_no % 3 <> 0) over w as behind,
  lead(sequence_id) over w as aq, lead(start) over w as a_at, lead(flags) over w as af, lag(sequence_id) over w as bq, lag(start) over w as b_at, lag(flags) over w as bf from num window w as (partition by read_name order by rec_no))
select unique_id, cast(f | case when ahead then 1 | (case when af & 4 <> 0 then 8 else 0 end) | (case when af & 16 <> 0 then 32 else 0 end) else 0 end
  | case when behind then (case when bf & 4 <> 0 then 8 else 0 end) | (case when bf & 16 <> 0 then 32 else 0 end) else 0 end as int) as flags,
  case when ahead then aq when behind then bq end as next_sequence_id, case when ahead then a_at when behind then b_at end as next_start from k""".replace("af & 4 <>", "(af & 4) <>").replace("af & 16 <>", "(af & 16) <>").replace("bf & 4 <>", "(bf & 4) <>").replace("bf & 16 <>", "(bf & 16) <>"),
    "lossy_names": f"""with {_ALN}, {_NUMBERED}, k as (select *, case when l_suppkey % 4 = 0 then 'n' || l_partkey end as own, (rec_no - 1) // 3 as chain from num)
select unique_id, coalesce(own, first_value(coalesce(own, unique_id)) over (partition by read_name, chain order by rec_no)) as read_name from k""",
    "tag_last_wins": "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2",
    "tags_map": "with t as (select user_id, left(event_type, 2) as tag, arg_max(event_id % 1000, event_id) as v from events group by 1, 2) select user_id, count(*) as n_tags, cast(sum(v) as bigint) as tag_sum from t group by 1",
    "block_crc32": """with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps)
select doc_id, case when text is not null then xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint))),
  lambda c, b: xor(c >> 8, steps[cast((xor(c, b) & 255) as int) + 1])), 4294967295) end as crc32 from documents, t""",
    "reference_md5": "select doc_id, md5(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^!-~]', '', 'g')) as md5 from documents",
    "record_json": f"with {_ALN} select unique_id, start, length_on_ref, next_start from aln",
    "props_json": "select event_id, cast(props->>'$.k' as bigint) as k from events",
    "quality_text": f"""with q as (select {_KEYS}, list_transform(range(1, l_linenumber + 1), lambda i: 10 + (cast(l_quantity as int) + i) % 50) as q from lineitem)
select {_KEYS}, array_to_string(list_transform(q, lambda x: chr(cast(x + 33 as int))), '') as quality, cast(list_sum(q) as int) as quality_sum, cast(q[1] as int) as first_quality from q""",
    "run_merge": """with e as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as island from events)
select user_id, event_type, min(event_id) as first_event, count(*) as n_events from e group by user_id, event_type, island""",
    "reference_lookup": "with r as (select row_number() over (order by n_nationkey) - 1 as ref_id, n_name as name from nation) select s_suppkey, cast(s_suppkey % 30 as int) as ref_id, name from supplier left join r on s_suppkey % 30 = r.ref_id",
    "header_tokens": "select c_custkey, 'SQ' as tag, concat('SN=', c_name, '|LN=', c_custkey, '|', c_mktsegment, '=') as fields from customer",
    "unplaced_reads": f"with {_ALN} select unique_id, cast(-1 as bigint) as start from aln where (flags & 4) <> 0",
    "reference_list": "select cast(row_number() over (order by n_nationkey) - 1 as int) as ref_id, n_name as name, cast(n_nationkey * 100 + 7 as bigint) as length, md5(n_name) as md5 from nation",
    "sam_reads": """select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as read, case when l_linenumber <> 3 then concat('r', l_orderkey) end as read_name, cast(l_linenumber * 16 as int) as flags, cast(case when l_linenumber = 7 then -1 else l_suppkey % 5 end as int) as sequence_id,
  cast(l_partkey as int) as start, case when (l_linenumber * 16) & 4 = 0 then cast(l_quantity as int) + 3 end as length_on_ref, cast(l_linenumber * 8 as int) as mapping_quality,
  cast(case when l_linenumber % 2 = 0 then l_suppkey % 5 else l_partkey % 5 end as int) as next_sequence_id, cast(l_suppkey as int) as next_start, cast(l_quantity as int) - 20 as template_length, 'ACGTN' as read_bases,
  concat(cast(l_quantity as int), 'M2I3D1S') as cigar, 2 as last_quality, cast(l_linenumber as bigint) as nm, l_returnflag as xz, cast(-1 as bigint) as xb, true as no_tag from lineitem""",
    "sam_text": f"""with t as (select *, {_SAM_SQL} as line from lineitem)
select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as read, case when l_linenumber % 2 = 1 and l_linenumber <> 7 and l_suppkey % 5 = l_partkey % 5 then replace(line, concat('M2I3D1S', chr(9), 'S', l_partkey % 5), concat('M2I3D1S', chr(9), '=')) else line end as line from t""".replace("'\\t'", "chr(9)"),
    "fasta_sequences": "select n_name as name, concat(md5(n_name), 'ACGT', md5(reverse(n_name))) as seq from nation",
    "index_entries": "select user_id % 7 - 1 as seq_id, event_id as start, event_id % 50 as span, event_id * 3 as container_start, cast(7 as bigint) as slice_start, event_id % 900 + 1 as slice_bytes from events",
    "index_estimate": "select cast(r.range as int) as seq_id, count(event_id) as slices, cast(coalesce(sum(event_id % 900 + 1), 0) as bigint) as total_bytes from range(3) r left join events on user_id % 7 - 1 = r.range and event_id < 700 and event_id + event_id % 50 > 100 group by 1",
    "index_in_order": "select event_id as start, event_id % 50 as span, event_id % 900 + 1 as slice_bytes from events where user_id % 7 - 1 = 2 and event_id + event_id % 50 > 0",
    "storage_flags": f"select l_linenumber, {', '.join(f'cast(count_if((l_linenumber * 3 % 16) & {v} <> 0) as bigint) as {k}'.replace('% 16) &', '% 16 &').replace(f'& {v} <>', f'& {v}) <>').replace('(l_linenumber', '((l_linenumber').replace('* 3 % 16', '* 3 % 16)') for k, v in STORAGE_FLAGS.items())} from lineitem group by 1",
    "substitutions": f"""with b as (select {_KEYS}, cast(l_suppkey % 4 as int) as code, upper(substr('ACGTNacx', cast(l_partkey % 8 as int) + 1, 1)) as base from lineitem),
m as (select *, case base when 'A' then [0, 1, 2, 3] when 'C' then [3, 2, 1, 0] when 'G' then [1, 0, 3, 2] when 'T' then [2, 3, 0, 1] else [0, 1, 2, 3] end as codes, replace('ACGTN', case when base in ('A', 'C', 'G', 'T') then base else 'N' end, '') as others from b)
select {_KEYS}, substr(others, list_position(codes, code), 1) as base from m""",
    "merged_cigar": f"select {_KEYS}, concat(cast(l_quantity as int) + l_linenumber, 'M', case when l_linenumber % 2 = 1 then '2I1D2I' else '3I' end, '7M') as cigar from lineitem",
    "detached_mates": f"with {_ALN} select unique_id, cast(flags | case when l_partkey % 2 = 1 then 32 else 0 end | case when l_partkey % 4 >= 2 then 8 else 0 end as int) as flags, case when l_suppkey % 3 <> 0 then sequence_id end as next_sequence_id, case when l_suppkey % 3 <> 0 then start end as next_start from aln",
    "stored_bases": f"""with {_FEAT}, r as (select {_KEYS}, start, ref from feat join refs on feat.ref_id = refs.ref_id)
select {_KEYS}, 'H' as code, start as ref_pos, 0 as length, '' as bases, -1 as qual, '' as ref_base, 4 as clip_length from r
union all select {_KEYS}, 'X', start + 1, 1, 'A', 33, substr(ref, start + 2, 1), 0 from r where substr(ref, start + 2, 1) <> 'A'
union all select {_KEYS}, 'I', start + 3, 0, 'CG', -1, '', 2 from r
union all select {_KEYS}, 'X', cast(start + 4 + j as int), 1, substr('ACG', cast(j + 1 as int), 1), cast(36 + j as int), substr(ref, cast(start + 5 + j as int), 1), 0 from r, (select range as j from range(3)) where substr(ref, cast(start + 5 + j as int), 1) <> substr('ACG', cast(j + 1 as int), 1)
union all select {_KEYS}, 'N', start + 8, 12, '', -1, '', 0 from r""",
    "resolved_features": f"with {_FEAT} select {_KEYS}, substr(ref, start + 5 - c + 1, 1) as ref_base, substr(replace('ACGTN', substr(ref, start + 5 - c + 1, 1), ''), 3, 1) as base from feat join refs on feat.ref_id = refs.ref_id",
    "pairs_by_index": "select *, start // 1000 as slice from (" + _pairs_sql(2, 2000, 4000, 3000, False, False) + ")",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        overlap_range, flag_matrix, pair_orientation, view_as_pairs, view_as_pairs_across, range_join, template_length, mate_chain_lengths, slice_index, slice_prune, has_data, coverage_depth, cigar_spans, clip_lengths, packed_cigar,
        op_histogram, feature_cigar, read_bases, mismatches, mismatches_in_window, tag_last_wins, tags_map, reference_md5, block_crc32, record_json, props_json, quality_text, run_merge, reference_lookup, header_tokens, unplaced_reads,
        placed_features, reference_join, reference_spans, delta_starts, mate_association, lossy_names, reference_list, sam_reads, sam_text, fasta_sequences, index_entries, index_estimate, index_in_order, storage_flags, substitutions, merged_cigar, detached_mates,
        stored_bases, resolved_features, pairs_by_index,
    ]
    return {"pairs_in_range": flagship} | {f.__name__: f for f in found} | text_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | text_queries.oracle_sql()
