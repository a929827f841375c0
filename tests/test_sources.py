"""SAM, FASTA and index text, from hand-written files."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from readloom.sources import read_crai, read_fasta, read_header, read_sam, reference_chunks, references, sam_lines
from readloom.sources.crai import byte_estimate, entries_for_range, has_data

SAM = """@HD\tVN:1.6
@SQ\tSN:a\tLN:100\tM5:abc
@SQ\tSN:b\tLN:200
@CO\tfree text
r1\t99\ta\t10\t60\t5H4S6M\t=\t30\t25\tACGTACGTAC\tIIIIIIIIII\tNM:i:3\tXX:Z:a:b\tNM:i:4\tXB:B:c,1,-2\tXF:f:1.5\tXH:H:1F
r1\t147\ta\t30\t60\t5M2D5M\t=\t10\t-25\tACGTACGTAC\t*
r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
r3\t1\tb\t7\t9\t3M\ta\t2\t0\tACG\t!!!
"""


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    return str(path)


def test_header_and_references(spark, sam):
    header = read_header(spark, sam).orderBy("line_no").collect()
    assert [r["tag"] for r in header] == ["HD", "SQ", "SQ", "CO"]
    assert [(x["tag"], x["value"]) for x in header[3]["data"]] == [("free text", "")]
    refs = references(read_header(spark, sam)).orderBy("ref_id").select("ref_id", "name", "length", "md5").collect()
    assert [tuple(r) for r in refs] == [(0, "a", 100, "abc"), (1, "b", 200, None)]


def test_reference_without_length_fails(spark, tmp_path):
    (tmp_path / "y.sam").write_text("@SQ\tSN:a\n")
    with pytest.raises(Exception, match="lacks SN or LN"):
        references(read_header(spark, str(tmp_path / "y.sam"))).collect()


def test_rows(spark, sam):
    a, b, c, d = read_sam(spark, sam).orderBy("rec_no").collect()
    assert (a["sequence_id"], a["start"], a["length_on_ref"], a["next_sequence_id"], a["next_start"]) == (0, 9, 6, 0, 29)
    assert (a["tags"]["NM"]["i"], a["tags"]["XX"]["s"], a["tags"]["XB"]["ai"], a["tags"]["XF"]["f"], a["tags"]["XH"]["i"]) == (4, "a:b", [1, -2], 1.5, 31)
    assert a["quals"] == [40] * 10 and b["quals"] is None and b["length_on_ref"] == 12
    assert (c["sequence_id"], c["start"], c["length_on_ref"], c["next_sequence_id"], c["read_bases"]) == (-1, -1, None, None, None)
    assert (d["sequence_id"], d["next_sequence_id"], d["next_start"], d["quals"]) == (1, 0, 1, [0, 0, 0])


def test_text_round_trip(spark, sam):
    rows, refs = read_sam(spark, sam), references(read_header(spark, sam))
    lines = [r["line"] for r in sam_lines(rows, refs).orderBy("rec_no").collect()]
    want = [x for x in SAM.splitlines() if not x.startswith("@")]
    assert [x.split("\t")[:11] for x in lines] == [x.split("\t")[:11] for x in want]
    assert set(lines[0].split("\t")[11:]) == {"NM:i:4", "XX:Z:a:b", "XB:B:c,1,-2", "XF:f:1.5", "XH:H:1F"}


def test_short_line_fails(spark, tmp_path):
    (tmp_path / "z.sam").write_text("@SQ\tSN:a\tLN:5\nr\t0\ta\t1\n")
    with pytest.raises(Exception, match="under 11 fields"):
        read_sam(spark, str(tmp_path / "z.sam")).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\nTTT\n")
    rows = {r["name"]: r["seq"] for r in read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert rows == {"a": "ACGTAC", "b": "TTT"}
    chunks = reference_chunks(read_fasta(spark, str(tmp_path / "x.fa")).withColumn("ref_id", F.ascii("name") - 97), 4, 1).orderBy("ref_id", "chunk").collect()
    assert [(r["ref_id"], r["chunk_start"], r["seq"]) for r in chunks] == [(0, 0, "ACGTA"), (0, 4, "AC"), (1, 0, "TTT")]


@pytest.mark.parametrize("pack", [False, True])
def test_crai(spark, tmp_path, pack):
    text = b"0\t1\t20\t562\t143\t200\r\n\n-1\t1\t20\t562\t143\t200\n0\t1\t20\t562\t143\t200\n0\t31\t0\t900\t10\t50"
    (tmp_path / "x.crai").write_bytes(gzip.compress(text[:20]) + gzip.compress(text[20:]) if pack else text)
    index = read_crai(spark, str(tmp_path / "x.crai"))
    assert sorted(tuple(r) for r in index.collect()) == [(-1, 0, 20, 562, 143, 200), (0, 0, 20, 562, 143, 200), (0, 0, 20, 562, 143, 200), (0, 30, 0, 900, 10, 50)]  # equal lines stay
    assert entries_for_range(index, 0, 19, 40).count() == 3
    assert entries_for_range(index, 0, 30, 40).count() == 0  # a span of 0 needs a start beyond the query's
    assert has_data(index, -1) and not has_data(index, 7)
    assert byte_estimate(index, 0, 0, float("inf")).first()["total_bytes"] == 450


@pytest.mark.parametrize("bad", ["0\t1\t2\t3\t4", "0\t1\t2\t3\t4\t5\t6", "0\t\t2\t3\t4\t5", "a\tb\tc\td\te\tf"])
def test_bad_crai(spark, tmp_path, bad):
    (tmp_path / "x.crai").write_text(bad + "\n")
    with pytest.raises(Exception, match="not a slice index line"):
        read_crai(spark, str(tmp_path / "x.crai")).collect()


def test_bai_is_refused(spark, tmp_path):
    (tmp_path / "x.bai").write_bytes(b"BAI\x01\x00\x00")
    with pytest.raises(Exception, match="BAI"):
        read_crai(spark, str(tmp_path / "x.bai")).collect()
