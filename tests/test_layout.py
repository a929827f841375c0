"""Slices with a stored index, the SAM data source, and features from aligned reads."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readloom import functions as R
from readloom import sources as S
from readloom.sources.sam_source import Range, SamReader, SamSource, load_sam

# ---------------------------------------------------------------- slices


@pytest.fixture(scope="module")
def reads(spark):
    """Reads on three sequences, a third of them at one place, some without a sequence."""
    rng = random.Random(1)
    rows = [(i, 1, 500, 10) for i in range(1000)]
    rows += [(1000 + i, rng.choice([0, 1, 2]), rng.randint(0, 5000), rng.choice([None, 0, 20, 300])) for i in range(1900)]
    rows += [(2900 + i, -1, -1, None) for i in range(50)] + [(2950 + i, None, None, None) for i in range(50)]
    return spark.createDataFrame(rows, "id long, sequence_id int, start int, length_on_ref int").repartition(3)


@pytest.fixture(scope="module")
def sliced(spark, reads, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("slices") / "x")
    S.write_slices(reads, path, slice_reads=100, partitions=8)
    return path


def inside(r, sequence_id, start, end):
    return r["sequence_id"] == sequence_id and r["start"] < end and r["start"] + max(1, r["length_on_ref"] or 1) > start


@pytest.mark.parametrize("sequence_id, start, end", [(1, 490, 510), (0, 100, 200), (2, 4990, 9000), (1, 0, float("inf")), (-1, -1, 0), (7, 0, 10), (0, 800, 800)])
def test_slice_range(spark, reads, sliced, sequence_id, start, end):
    got = S.read_range(spark, sliced, sequence_id, start, end)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in reads.collect() if inside(r, sequence_id, start, end))


def test_slices_opened(spark, reads, sliced):
    """Only files that the index names are opened, and the place of a third of all reads lies in several."""
    every = spark.read.parquet(f"{sliced}/reads")
    assert every.count() == reads.count() and len(every.inputFiles()) >= 30
    some = [f.removeprefix("file://") for f in S.read_range(spark, sliced, 0, 100, 200).inputFiles()]
    named = {r["file"].removeprefix("file:") for r in S.slice_index(spark, sliced).collect() if r["sequence_id"] == 0 and r["start"] < 200 and r["start"] + r["span"] > 100}
    assert set(some) == named and len(some) <= 8
    hot = every.filter("sequence_id = 1 and start = 500").select(F.input_file_name()).distinct().count()
    assert hot >= 10
    index = S.slice_index(spark, sliced).collect()
    assert sum(r["n_reads"] for r in index) == reads.count() and all(r["n_reads"] <= 100 for r in index)


def test_slice_regions(spark, reads, sliced):
    regions = [(k, k % 3, 37 * k, 37 * k + k) for k in range(30)]
    got = S.read_regions(spark, sliced, spark.createDataFrame(regions, "region_id int, sequence_id int, region_start int, region_end int"), 64)
    want = sorted((r["id"], k) for r in reads.collect() for k, s, a, b in regions if a < b and inside(r, s, a, b))
    assert sorted((r["id"], r["region_id"]) for r in got.collect()) == want


@pytest.mark.parametrize("n, most", [(30, False), (160, True)])
def test_slice_regions_list_few_paths(spark, reads, sliced, n, most):
    """Where most files are named the folder is opened, not a path for each; else only those named are."""
    regions = spark.createDataFrame([(k, 0 if not most else k % 4 - 1, 40 * (k // 4), 40 * (k // 4) + 200) for k in range(0, 4 * n, 1 if most else 40)], "region_id int, sequence_id int, region_start int, region_end int")
    got = S.read_regions(spark, sliced, regions, 64)
    every = len(spark.read.parquet(f"{sliced}/reads").inputFiles())
    paths = re.search(r"InMemoryFileIndex\((\d+) paths\)", got._jdf.queryExecution().executedPlan().toString())
    assert (int(paths[1]) == 1 and len(got.inputFiles()) == every) if most else len(got.inputFiles()) == int(paths[1]) < every / 2
    asked = regions.collect()
    want = sorted((r["id"], g["region_id"]) for r in reads.collect() for g in asked if r["sequence_id"] == g["sequence_id"] and inside(r, g["sequence_id"], g["region_start"], g["region_end"]))
    assert sorted((r["id"], r["region_id"]) for r in got.collect()) == want


def test_no_slices(spark, reads, tmp_path):
    S.write_slices(reads.limit(0), str(tmp_path / "none"))
    assert S.read_range(spark, str(tmp_path / "none"), 0, 0, 100).count() == 0 and S.slice_index(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- SAM data source


@pytest.fixture(scope="module")
def sam(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sam")
    rng = random.Random(2)
    for name in ("one.sam", "two.sam"):
        lines = ["@HD\tVN:1.6", "@SQ\tSN:a\tLN:9000", "@SQ\tSN:b\tLN:9000"]
        rows = sorted((rng.choice("ab*"), rng.randint(1, 9000), i) for i in range(700))
        lines += [f"{name[0]}{i}\t0\t{seq}\t{at if seq != '*' else 0}\t9\t{'*' if seq == '*' else '5M3D5M'}\t*\t0\t0\t{'A' * 10 if i % 3 else '*'}\t*\tNM:i:{i}" for seq, at, i in rows]
        (folder / name).write_text("\n".join(lines) + ("\n" if name == "one.sam" else ""))
    return str(folder)


@pytest.fixture(scope="module")
def index(spark, sam, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "x")
    S.index_sam(spark, sam, at, block_bytes=2000)
    return at


@pytest.mark.parametrize("block", [1, 37, 5000, 1 << 26])
def test_source_rows(spark, sam, block):
    """Whatever the blocks are, each line comes once, with what the reader of lines makes of it."""
    got = load_sam(spark, sam, block_bytes=block if block > 1 else 300)
    want = S.read_sam(spark, sam)
    plain = lambda df: sorted(map(repr, df.select("read_name", "start", "mapping_quality", "read_bases", R.cigar_string(F.col("cigar")).alias("cigar"), R.get_tag("tags", "NM")["i"].alias("nm")).collect()))
    assert plain(got) == plain(want)
    assert got.select(F.countDistinct("file", "offset")).first()[0] == 1400


def test_source_range(spark, sam, index):
    got = S.sam_range(spark, sam, index, "b", 3000, 3300, ["read_name", "start"])
    want = S.read_sam(spark, sam).filter("sequence_id = 1 and start < 3300 and start + 13 > 3000").select("read_name", "start")
    assert got.columns == ["read_name", "start"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
    assert S.sam_range(spark, sam, index, "nowhere", 0, 10).count() == 0


def planned(path, index, **options):
    reader = SamSource({"path": path, "index": index, "block_bytes": "2000", **options}).reader(SamSource({}).schema())
    return reader.partitions()


def test_source_plan(spark, sam, index):
    """A range plans few of the files' bytes."""
    every = sum(r.end - r.begin for r in SamReader({"path": sam, "block_bytes": "2000"}, SamSource({}).schema()).partitions())
    some = sum(r.end - r.begin for r in planned(sam, index, rname="b", start="3000", end="3300"))
    assert 0 < some < every / 5
    assert planned(sam, index, rname="nowhere") == [Range("", 0, 0)]


def test_source_pushes_filters(spark, sam, index):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = load_sam(spark, sam, index).filter("rname = 'a' and start >= 8000 and start < 8500")
        n = len({(r["file"], r["block"]) for r in rows.collect()})
        want = S.read_sam(spark, sam).filter("sequence_id = 0 and start >= 8000 and start < 8500").count()
        assert rows.count() == want > 0 and rows.rdd.getNumPartitions() == n < 8
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_source_is_strict(spark, tmp_path):
    (tmp_path / "z.sam").write_text("@SQ\tSN:a\tLN:5\nr\t0\ta\t1\n")
    with pytest.raises(Exception, match="under 11 fields"):
        load_sam(spark, str(tmp_path / "z.sam")).collect()
    (tmp_path / "empty.sam").write_text("")
    assert load_sam(spark, str(tmp_path / "empty.sam")).count() == 0


# ---------------------------------------------------------------- features from aligned reads


def by_walk(ops, bases, start, ref, ref_start, quals):
    """(code, pos, ref_pos, num, payload, ref, sub), base by base."""
    out, at, pos = [], start, 0
    for n, op in ops:
        if op in "M=X":
            if bases is not None and ref is None and n:
                out.append(("b", pos, at, n, bases[pos : pos + n].upper(), None, None))
            for j in range(n if bases is not None and ref is not None else 0):
                own, k = bases[pos + j].upper(), at + j - ref_start
                theirs = ref[k].upper() if 0 <= k < len(ref) else None
                own = (theirs or "N") if own == "=" else own
                if own == theirs:
                    continue
                if own in "ACGTN":
                    out.append(("X", pos + j, at + j, "ACGTN".replace(theirs if theirs and theirs in "ACGTN" else "N", "").find(own), None, theirs, own))
                else:
                    out.append(("B", pos + j, at + j, quals[pos + j] if quals else -1, own, theirs, None))
        elif n:
            payload = ("N" * n if bases is None else bases[pos : pos + n].upper()) if op in "IS" else None
            out.append((op, pos, at, n, payload, None, None))
        pos += n if op in "M=XIS" else 0
        at += n if op in "M=XDN" else 0
    return out


def test_aligned_features(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(400):
        ops = [(rng.randint(0, 6), rng.choice("MIDNSHP=X")) for _ in range(rng.randint(0, 7))]
        n = sum(k for k, op in ops if op in "MIS=X")
        bases = None if i % 9 == 0 else "".join(rng.choice("ACGTNacgt=RY") for _ in range(n))
        ref = None if i % 7 == 0 else "".join(rng.choice("ACGTNacgtM") for _ in range(30))
        ref_start, quals = rng.randint(0, 5), None if i % 2 else [rng.randint(0, 60) for _ in range(n)]
        start = ref_start + rng.randint(0, 20)
        cigar = None if i % 50 == 3 else ops
        rows.append((i, None if cigar is None else [{"op": op, "len": k} for k, op in ops], bases, start, ref, ref_start, quals))
        want.append(None if not cigar else by_walk(ops, bases, start, ref, ref_start, quals))
    df = spark.createDataFrame(rows, "id int, cigar array<struct<op string, len int>>, bases string, start int, ref string, ref_start int, quals array<int>").repartition(3)
    made = R.features_from_alignment(F.col("cigar"), F.col("bases"), F.col("start"), F.col("ref"), F.col("ref_start"), F.col("quals"))
    got = {r["id"]: r["f"] for r in df.select("id", made.alias("f")).collect()}
    for i, w in enumerate(want):
        assert (None if got[i] is None else [tuple(x) for x in got[i]]) == w, rows[i]


def test_alignment_comes_back(spark):
    """Bases and CIGAR of a read are those of its features, with a reference and without."""
    rows = [(1, "5H3S4M2I3M2D3M1P2M", "tttACGAGGTACGTAAC", 2), (2, "4=1X3=", "ACGTTACG", 0), (3, "3M5N3M", "ACGACG", 1), (4, "4M", "====", 3), (5, "2S", "AC", 0)]
    ref = "ACGTACGTACGTACGTACGT"
    df = spark.createDataFrame(rows, "id int, cigar string, bases string, start int").withColumn("ops", R.parse_cigar("cigar"))
    for r in (F.lit(ref), F.lit(None).cast("string")):
        made = df.withColumn("f", R.features_from_alignment(F.col("ops"), F.col("bases"), F.col("start"), r, F.lit(0)))
        known = F.lit(ref) if r is not None else F.lit("")
        got = {x["id"]: x for x in made.filter("id <> 4").select("id", R.read_bases(F.col("f"), F.col("start"), F.length("bases"), known, F.lit(0)).alias("b"), R.cigar_string(R.cigar_from_features(F.col("f"), F.col("start"), F.length("bases"))).alias("c")).collect()}
        assert all(got[i]["b"] == b.upper() for i, _, b, _ in rows if i != 4)
        assert got[1]["c"] == "5H3S4M2I3M2D3M1P2M" and got[2]["c"] == "8M" and got[3]["c"] == "3M5N3M"
    same = df.filter("id = 4").select(R.features_from_alignment(F.col("ops"), F.col("bases"), F.col("start"), F.lit(ref), F.lit(0)).alias("f")).first()["f"]
    assert same == []


def test_cigar_must_fit(spark):
    df = spark.createDataFrame([("4M", "ACG")], "cigar string, bases string")
    with pytest.raises(Exception, match="not that of the read's bases"):
        df.select(R.features_from_alignment(R.parse_cigar("cigar"), F.col("bases"), F.lit(0), F.lit("ACGT"), F.lit(0))).collect()


def test_source_blocks_are_not_tasks(spark, sam):
    """An index of small blocks is made by tasks of many blocks each, and lines are told to their blocks as by a task a block."""
    size = sum(f.stat().st_size for f in Path(sam).iterdir())
    parts = SamReader({"path": sam, "block_bytes": "500"}, SamSource({}).schema()).partitions()
    assert len(parts) == 2 and sum(r.end - r.begin for r in parts) == size
    rows = load_sam(spark, sam, block_bytes=500, columns=["file", "offset", "block"])
    assert rows.filter("block != floor(offset / 500) * 500").isEmpty() and rows.select("file", "block").distinct().count() > 50


def test_source_builds_only_named_fields(spark, tmp_path):
    """A field that is not asked for is not parsed, so a tag that is no number does no harm."""
    (tmp_path / "t.sam").write_text("r\t0\ta\t1\t9\t1M\t*\t0\t0\tA\t*\tNM:i:x\n")
    assert [tuple(r) for r in load_sam(spark, str(tmp_path / "t.sam"), columns=["rname", "reach"]).collect()] == [("a", 1)]
    with pytest.raises(Exception):
        load_sam(spark, str(tmp_path / "t.sam"), columns=["tags"]).collect()
