"""Expressions and operators against plain Python walks and hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom import functions as R
from readloom import operators as O
from readloom import sources as S
from readloom.model import FEATURE, MalformedInputError


def _random_read(rng):
    """A read with features that add up, its reference, and its bases and CIGAR by a walk."""
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    start, at, feats, bases, ops = 10, 10, [], "", []

    def op(o, n):
        if n:
            if ops and ops[-1][0] == o:
                ops[-1][1] += n
            else:
                ops.append([o, n])

    for _ in range(rng.randint(0, 7)):
        gap = rng.choice([0, 0, 1, 4])
        bases += ref[at : at + gap]
        at += gap
        op("M", gap)
        code = rng.choice("XBbDNISHPiqQ")
        n, word = rng.randint(1, 4), "".join(rng.choice("ACGT") for _ in range(4))
        f = {"code": code, "pos": len(bases), "ref_pos": at, "num": n, "payload": None, "ref": None, "sub": None}
        if code == "X":
            f["sub"] = rng.choice("ACGT")
            bases, at = bases + f["sub"], at + 1
            op("M", 1)
        elif code == "B":
            f["payload"], f["num"] = word[0], 30
            bases, at = bases + word[0], at + 1
            op("M", 1)
        elif code == "b":
            f["payload"] = word[:n]
            bases, at = bases + word[:n], at + n
            op("M", n)
        elif code in "DN":
            at += n
            op(code, n)
        elif code in "IS":
            f["payload"] = word[:n]
            bases += word[:n]
            op(code, n)
        elif code == "i":
            f["payload"], f["num"] = word[0], 0
            bases += word[0]
            op("I", 1)
        elif code in "HP":
            op(code, n)
        feats.append(f)
    tail = rng.randint(0, 5)
    bases += ref[at : at + tail]
    op("M", tail)
    return ref, start, feats, bases, "".join(f"{n}{o}" for o, n in ops) or "*"


def test_bases_and_cigar_follow_the_walk(spark):
    rng = random.Random(7)
    reads = [_random_read(rng) for _ in range(400)]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("features", T.ArrayType(FEATURE)), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([(i, r, s, f, len(b)) for i, (r, s, f, b, _) in enumerate(reads)], schema)
    got = df.select("id", R.read_bases(F.col("features"), F.col("start"), F.col("n"), F.col("ref"), F.lit(0)).alias("b"), R.cigar_string(R.cigar_from_features(F.col("features"), F.col("start"), F.col("n"))).alias("c")).collect()
    for r in got:
        assert (r["b"], r["c"]) == (reads[r["id"]][3], reads[r["id"]][4])


def _features(spark, feats, **more):
    full = [{"code": "", "pos": 0, "ref_pos": 0, "num": 0, "payload": None, "ref": None, "sub": None} | f for f in feats]
    return spark.createDataFrame([(full,)], T.StructType([T.StructField("features", T.ArrayType(FEATURE))]))


def test_contradicting_features_raise(spark):
    df = _features(spark, [{"code": "I", "payload": "ACGTACGT", "num": 8, "ref_pos": 0}])
    with pytest.raises(Exception, match="do not add up"):
        df.select(R.read_bases(F.col("features"), F.lit(0), F.lit(4), F.lit("ACGT"), F.lit(0))).collect()


def test_mismatches(spark):
    df = _features(
        spark,
        [
            {"code": "S", "ref_pos": 10, "num": 3, "payload": "TTT"}, {"code": "X", "pos": 4, "ref_pos": 11, "sub": "G"}, {"code": "i", "pos": 6, "ref_pos": 13, "payload": "A"}, {"code": "i", "pos": 7, "ref_pos": 13, "payload": "C"}, {"code": "q", "ref_pos": 13},
            {"code": "i", "pos": 8, "ref_pos": 14, "payload": "T"}, {"code": "D", "ref_pos": 15, "num": 4}, {"code": "B", "pos": 9, "ref_pos": 19, "payload": "a", "num": 33}, {"code": "b", "pos": 10, "ref_pos": 20, "payload": "AAC", "num": 3}, {"code": "P", "ref_pos": 23, "num": 2}, {"code": "H", "ref_pos": 24, "num": 5},
        ],
    )
    ref = "AAAAAAAAAA" + "ACGTACGTAC" + "AGCTAAAAAA"
    got = df.select(F.explode(R.mismatches(F.col("features"), F.lit(ref), F.lit(0))).alias("m")).select("m.code", "m.ref_pos", "m.length", "m.bases", "m.qual", "m.ref_base", "m.clip_length").collect()
    assert [tuple(r) for r in got] == [
        ("S", 10, 0, "", -1, None, 3), ("X", 11, 1, "G", -1, "C", 0), ("I", 13, 0, "AC", -1, None, 2), ("I", 14, 0, "T", -1, None, 1), ("D", 15, 4, "", -1, None, 0), ("X", 19, 1, "a", 33, "C", 0), ("X", 21, 1, "A", -1, "G", 0), ("H", 24, 0, "", -1, None, 5),
    ]
    inside = df.select(R.mismatches(F.col("features"), F.lit(ref), F.lit(0), window_start=14, window_end=19, origin=10).alias("m")).first()["m"]
    assert [(m["code"], m["ref_pos"]) for m in inside] == [("I", 4), ("D", 5)]


@pytest.mark.parametrize(("text", "lead", "trail", "span"), [("5H4S10M", 5, 0, 10), ("10M3I2D4N5S", 0, 5, 16), ("*", 0, 0, None), ("7S", 7, 7, 0)])
def test_cigar_text(spark, text, lead, trail, span):
    ops = R.parse_cigar(F.lit(text))
    got = spark.range(1).select(R.leading_clip(ops), R.trailing_clip(ops), R.cigar_length_on_ref(ops), R.cigar_string(ops)).first()
    assert tuple(got) == (lead, trail, span, text)


def test_overlap_edges(spark):
    rows = spark.createDataFrame([(0, 10, 5), (0, 15, None), (0, 20, 0), (-1, -1, None)], "sequence_id int, start int, length_on_ref int")
    hit = lambda s, a, b: sorted(r["start"] for r in O.range_query(rows, s, a, b).collect())
    assert hit(0, 14, 15) == [10] and hit(0, 15, 16) == [15] and hit(0, 20, 21) == [20] and hit(0, 21, 99) == []
    assert hit(-1, -1, float("inf")) == [-1] and hit(-1, 0, 99) == []


def test_range_join_is_the_plain_join(spark):
    rng = random.Random(3)
    reads = [(i, rng.randint(0, 2), rng.randint(0, 300), rng.choice([None, 0, 1, 30, 200])) for i in range(200)]
    regions = [(i, rng.randint(0, 2), s := rng.randint(0, 300), s + rng.randint(1, 90)) for i in range(60)]
    a = spark.createDataFrame(reads, "id int, sequence_id int, start int, length_on_ref int")
    b = spark.createDataFrame(regions, "region_id int, sequence_id int, region_start int, region_end int")
    got = sorted((r["id"], r["region_id"]) for r in O.range_join(a, b, 16).collect())
    want = sorted((i, k) for i, s, p, n in reads for k, t, lo, hi in regions if s == t and p < hi and p + max(n or 1, 1) > lo)
    assert got == want


def test_orientation(spark):
    rows = [(99, 0, 10, 0, 30), (147, 0, 30, 0, 10), (99, 0, 10, None, None), (147, 0, 30, None, None), (65, 0, 10, 0, 30), (0, 0, 10, 0, 30), (99, 1, 10, 0, 90)]
    df = spark.createDataFrame(rows, "flags int, sequence_id int, start int, next_sequence_id int, next_start int")
    assert [r[0] for r in df.select(R.pair_orientation()).collect()] == ["F1R2", "F1R2", "F1R2", "F1R2", "F1F2", None, "R2F1"]


def test_template_length(spark):
    df = spark.createDataFrame([(10, 5, 20, 5), (20, 5, 10, 5), (10, 5, 10, 9), (10, 9, 10, 5)], "a int, n int, b int, m int")
    assert [r[0] for r in df.select(R.template_length(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).collect()] == [15, -15, 9, 9]


def test_chains(spark):
    df = spark.createDataFrame([("s", 0, 1, 10, 5), ("s", 1, 3, 40, 5), ("s", 2, None, 7, 5), ("s", 3, None, 10, 5)], "slice string, rec_no int, mate_no int, start int, read_length int")
    got = O.chain_template_lengths(O.mate_chains(df, ["slice"]), ["slice"]).orderBy("rec_no").collect()
    assert [(r["chain"], r["template_length"]) for r in got] == [(0, 35), (0, -35), (2, None), (0, 35)]
    with pytest.raises(MalformedInputError, match="forward"):
        O.mate_chains(spark.createDataFrame([("s", 1, 0)], "slice string, rec_no int, mate_no int"), ["slice"])


@pytest.mark.parametrize("block", [1 << 14, 8])
def test_chains_are_those_of_a_walk(spark, block):
    """Chains that wander over each other, pointers to no read, reads that two point at, null keys; with pointers within blocks and beyond them."""
    rng = random.Random(7)
    rows, want = [], []
    for k in range(40):
        numbers = sorted(rng.sample(range(60), rng.randint(1, 40)))
        heads: dict[int, list[int]] = {}
        for i, no in enumerate(numbers):
            to = rng.choice([None, no + rng.randint(1, 5), rng.choice(numbers[i + 1 : i + 6] or [None])])
            rows.append((f"s{k}", no, to, k * 100 + no))
            for head in heads.get(no, [no]):
                want.append((f"s{k}", no, k * 100 + no, head))
                heads.setdefault(to, []).append(head)
    rows += [(None, 1, 2, -1), (None, 2, None, -2)]
    df = spark.createDataFrame(rows, "slice string, rec_no int, mate_no int, at int").repartition(5)
    got = O.mate_chains(df, ["slice"], block=block)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("slice", "string"), ("rec_no", "int"), ("mate_no", "int"), ("at", "int"), ("chain", "int")]
    assert sorted((r["slice"], r["rec_no"], r["at"], r["chain"]) for r in got.collect()) == sorted(want)


def test_chains_and_names_need_no_join(spark):
    df = spark.createDataFrame([("s", 0, 1, "a", 5), ("s", 1, None, None, 6), ("s", 2, 3, None, 7), ("s", 3, None, None, 8)], "slice string, rec_no int, mate_no int, read_name string, unique_id int")
    named = O.propagate_names(O.mate_chains(df, ["slice"]), ["slice"])
    assert sorted((r["unique_id"], r["read_name"]) for r in named.collect()) == [(5, "a"), (6, "a"), (7, "7"), (8, "7")]
    assert "Join" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_coverage(spark):
    df = spark.createDataFrame([(0, 5, 10), (0, 8, 4), (0, 15, None), (1, 0, 2)], "sequence_id int, start int, length_on_ref int")
    got = sorted(tuple(r) for r in O.coverage_depth(df, 4).collect())
    assert got == [(0, 5, 1), (0, 8, 2), (0, 12, 1), (0, 15, 0), (1, 0, 1), (1, 2, 0)]


def test_qualities_and_flags(spark):
    q = F.array(F.lit(0), F.lit(40))
    got = spark.range(1).select(R.quality_string(q), R.quality_bytes(F.lit("!I")), R.quality_string(F.lit(None).cast("array<int>")), R.quality_at(q, 5), R.quality_at(F.lit(None).cast("array<int>"), 0), R.flag("is_read2", F.lit(128)), R.storage_flag("is_detached", F.lit(1)), R.reference_md5(F.lit("ac gt"))).first()
    assert tuple(got) == ("!I", [0, 40], "*", None, -1, True, False, "f1f8f4bf413b16ad135722aa4591043e")


def test_reads_stay_where_a_small_reference_is_sent(spark):
    """Reads are made once and not moved, and short and long ones find what a large reference's joins find, gaps and short chunks included."""
    rng = random.Random(5)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(90)) for k in range(2)}
    parts = [(k, c, s[c * 8 : c * 8 + 8][: 5 if (k, c) == (0, 6) else 8]) for k, s in seqs.items() for c in range(12) if (k, c) != (1, 4)]
    chunks = spark.createDataFrame(parts, "ref_id int, chunk int, seq string")
    made = "cast(id % 3 as int) as sequence_id", "cast(id * 7 % 95 - 2 as int) as start", "cast(id * 11 % 60 as int) as length_on_ref"
    reads = spark.range(0, 400, 1, 7).selectExpr("id", *made)
    got, want = (O.with_reference(reads, chunks, 8, ["id"], most=most) for most in (1 << 24, 0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 400") == 1 and plan.count("BroadcastHashJoin") == 2
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 400
    assert sum(r[-1] is not None and r[3] > 16 for r in rows) > 20 and sum(r[-1] is None for r in rows) > 100


def test_kernels_get_no_null_lists(spark):
    """Null lists take the square of a batch's rows in Spark's batch sizes, so qualities and tags that a read has none of go as empty lists."""
    lines = spark.createDataFrame([("f", 0, "r\t0\ta\t1\t9\t1M\t*\t0\t0\tA\t*\tNM:i:1\tXF:B:f,1.5,2.0\tXB:B:c,1")], "file string, at int, line string")
    refs = spark.createDataFrame([("f", 0, "a")], "file string, ref_id int, name string")
    rows = S.sam_rows(lines, refs)
    text = S.sam_lines(rows, refs)
    assert text.first()["line"] == lines.first()["line"]
    untyped = rows.withColumn("tags", F.transform_values("tags", lambda _, x: x.withField("sub", F.lit(None).cast("string"))))
    assert S.sam_lines(untyped, refs).first()["line"].endswith("XF:B:f,1.5,2.0\tXB:B:i,1")
    none = rows.withColumn("tags", F.lit(None).cast(rows.schema["tags"].dataType))
    assert S.sam_lines(none, refs).first()["line"].endswith("\tA\t*")
    for df in (text, rows.select(R.features_from_alignment(F.col("cigar"), F.col("read_bases"), F.col("start"), F.lit("C"), F.col("start"), F.col("quals")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "coalesce(quals" in plan and "coalesce(cigar" in plan


def test_many_regions_meet_reads_in_fitting_bins(spark):
    """Beyond an index, bins are as narrow as reads and regions are; a long region and a long read still meet all that they overlap."""
    from readloom.operators.region_index import fitting_width

    rng = random.Random(9)
    reads = [(i, i % 2, rng.randint(0, 4000), rng.choice([None, 0, 5, 40])) for i in range(300)] + [(300, 0, 10, 3000), (301, None, 5, 5)]
    regions = [(k, k % 2, a := rng.randint(0, 4000), a + rng.randint(0, 30)) for k in range(300)] + [(300, 0, 0, 4000), (301, 1, 7, None)]
    a = spark.createDataFrame(reads, "id int, sequence_id int, start int, length_on_ref int")
    b = spark.createDataFrame(regions, "region_id int, sequence_id int, region_start int, region_end int")
    assert fitting_width(a, b) == 64 and fitting_width(a, b.filter("region_id = 300")) == 4096
    got = sorted((r["id"], r["region_id"]) for r in O.region_join(a, b, most=10).collect())
    want = sorted((i, k) for i, s, at, n in reads for k, q, lo, hi in regions if s is not None and hi is not None and s == q and lo < hi and at < hi and at + max(1, n or 1) > lo)
    assert got == want and len(want) > 300


def test_runs_do_not_carry_all_events(spark, tmp_path):
    """A user's runs are told from their own events, without all of the user's events in the row of each run."""
    from readloom.plans.alignment_queries import run_merge

    rows = [(i, 1, "view" if i // 3 % 2 else "click") for i in range(3000)] + [(5000, 2, "error")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = run_merge(spark, str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(1, "view" if k % 2 else "click", 3 * k, 3) for k in range(1000)] + [(2, "error", 5000, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
