"""The dataset object, streams, and small expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom import functions as R
from readloom import operators as O
from readloom.dataset import AlignmentDataset
from readloom.model import FEATURE, ArgumentError
from readloom.streaming import slice_progress, stream_range

SAM = """@SQ\tSN:a\tLN:1000
@SQ\tSN:b\tLN:900
p\t99\ta\t11\t60\t10M\t=\t501\t500\tACGTACGTAC\t*
q\t67\ta\t21\t60\t10M\tb\t5\t0\tACGTACGTAC\t*
p\t147\ta\t501\t60\t10M\t=\t11\t-500\tACGTACGTAC\t*
q\t131\tb\t5\t60\t10M\ta\t21\t0\tACGTACGTAC\t*
u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*
"""


@pytest.fixture
def dataset(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    return AlignmentDataset.from_sam(spark, str(tmp_path / "x.sam"))


def test_dataset(dataset):
    names = lambda df: sorted((r["read_name"], r["start"]) for r in df.collect())
    assert names(dataset.range("a", 0, 100)) == [("p", 10), ("q", 20)]
    assert names(dataset.pairs("a", 0, 100)) == [("p", 10), ("p", 500), ("q", 20)]
    assert names(dataset.pairs("a", 0, 100, pair_across=True)) == [("p", 10), ("p", 500), ("q", 4), ("q", 20)]
    assert names(dataset.pairs("a", 0, 100, max_insert_size=100)) == [("p", 10), ("q", 20)]
    assert names(dataset.range(-1, -1)) == [("u", -1)]
    assert dataset.reference_name(1) == "b" and dataset.reference_name(7) is None and dataset.has_data("b")
    assert dataset.slices.count() == 3 and dataset.header.count() == 2
    with pytest.raises(ArgumentError, match="zz"):
        dataset.reference_id("zz")


def test_dataset_with_a_reference(spark, dataset, tmp_path):
    with pytest.raises(ArgumentError, match="with_fasta"):
        dataset.features()
    bases = "TTTTTTTTTTACGTACGTAC" + "ACGAACGTAC" + "N" * 970
    (tmp_path / "x.fa").write_text(">other\nAC\n>a one\n" + "\n".join(bases[i : i + 60] for i in range(0, 1000, 60)) + "\n>b\n" + "ACGT" * 225 + "\n")
    known = dataset.with_fasta(str(tmp_path / "x.fa"), 16)
    got = [tuple(r) for r in known.mismatches("a", 0, 100).select("code", "ref_pos", "bases", "ref_base", "qual").orderBy("ref_pos").collect()]
    assert got == [("X", 23, "T", "A", -1)]
    assert [r["ref_pos"] for r in known.mismatches("a", 20, 24, origin=20).collect()] == [3] and known.mismatches("a", 24, 100).count() == 0
    assert {r["read_name"]: r["features"] for r in known.features(known.range("b")).collect()} == {"q": []}
    regions = spark.createDataFrame([("x", 0, 0, 15), ("y", 0, 15, 600)], "region_id string, sequence_id int, region_start int, region_end int")
    assert sorted((r["region_id"], r["start"]) for r in known.regions(regions).collect()) == [("x", 10), ("y", 10), ("y", 20), ("y", 500)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, 5, 10), (0, 1500, 10), (1, 7, None)], "sequence_id int, start int, length_on_ref int").write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("sequence_id int, start int, length_on_ref int").parquet(str(tmp_path / "in"))
    for df, mode, want in ((slice_progress(reads), "complete", {(0, 0, 1, 5), (0, 1, 1, 1500), (1, 0, 1, 7)}), (stream_range(reads, 0, 0, 100), "append", {(0, 5, 10)})):
        q = df.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(f"out_{mode}").collect()} == want


def test_substitution(spark):
    # A: C G T N have codes 0 1 2 3; C: reversed
    matrix = F.array(F.lit(0b00011011), F.lit(0b11100100), *[F.lit(0b00011011)] * 3)
    got = spark.range(1).select(*[R.substitution(matrix, F.lit(b), F.lit(c)) for b, c in (("a", 0), ("A", 3), ("C", 3), ("C", 0), ("x", 2), ("T", 7))]).first()
    assert tuple(got) == ("C", "N", "A", "N", "G", None)


def test_places_and_lengths(spark):
    feats = [{"code": c, "pos": p, "ref_pos": 0, "num": n, "payload": w, "ref": None, "sub": None} for c, p, n, w in (("S", 0, 2, "AC"), ("X", 4, 0, None), ("D", 5, 3, None), ("i", 6, 0, "A"), ("X", 8, 0, None))]
    df = spark.createDataFrame([(feats,)], T.StructType([T.StructField("f", T.ArrayType(FEATURE))]))
    got = df.select(F.transform(R.place_features(F.col("f"), F.lit(100)), lambda x: x["ref_pos"]).alias("p"), R.length_on_ref(F.col("f"), F.lit(10)).alias("n")).first()
    assert (got["p"], got["n"]) == ([100, 102, 103, 107, 108], 10)


def test_reference_checks(spark):
    df = spark.createDataFrame([("ac gt", "f1f8f4bf413b16ad135722aa4591043e"), ("ac", "00000000000000000000000000000000"), ("ac", None), ("ac", "f1f8f4bf413b16ad135722aa4591043e")], "ref string, md5 string")
    assert [r["md5_ok"] for r in O.check_checksums(df).collect()] == [True, True, True, False]


def test_with_reference(spark):
    chunks = spark.createDataFrame([(0, 0, "ACGT"), (0, 1, "TTTT"), (0, 2, "GG")], "ref_id int, chunk int, seq string")
    reads = spark.createDataFrame([(1, 0, 2, 7), (2, 0, 9, 3), (3, 1, 0, 2), (4, 0, 0, None)], "id int, sequence_id int, start int, length_on_ref int")
    got = {r["id"]: r["ref"] for r in O.with_reference(reads, chunks, 4, ["id"]).collect()}
    assert got == {1: "GTTTTTG", 2: None, 3: None, 4: None}


def test_tags_as_variant(spark):
    fields = ["NM:i:3", "XZ:Z:a\"b\\c\u00e9", "NM:i:-4", "XB:B:c,-1,2", "XF:f:1.5", "XN:f:nan", "XH:H:1F", "XA:A:x", "BF:B:f,0.5,2", "BE:B:i", "XC:Z:\x01", "XI:I:4294967295"]
    df = spark.createDataFrame([(1, fields), (2, []), (3, None)], "id int, f array<string>").withColumn("v", R.tags_variant("f")).cache()
    one = lambda name, kind: R.variant_tag("v", name, kind)
    r = df.filter("id = 1").select(one("NM", "bigint"), one("XZ", "string"), one("XB", "array<bigint>"), one("XF", "double"), one("XN", "double"), one("XH", "string"), one("BF", "array<double>"), one("BE", "array<bigint>"), one("XC", "string"), one("XI", "bigint"), one("ZZ", "string"), R.variant_tag_type("v", "XB"), R.variant_tag_type("v", "NM"), F.size(R.variant_tags("v"))).first()
    assert tuple(r[:4]) == (-4, "a\"b\\c\u00e9", [-1, 2], 1.5) and r[4] != r[4] and tuple(r[5:]) == ("1F", [0.5, 2.0], [], "\x01", 4294967295, None, "Bc", "i", 11)
    assert [x[0] for x in df.orderBy("id").select(F.size(R.variant_tags("v"))).collect()[1:]] == [0, None] or df.filter("id = 3 and v is null").count() == 1
