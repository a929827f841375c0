"""FASTA by byte ranges gives the chunks of whole records, wherever blocks cut the file."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import fasta_chunks, fasta_index, read_fasta, reference_chunks


def written(tmp_path, seed, n=7):
    rng = random.Random(seed)
    lines = []
    for k in range(n):
        lines.append(f">s{k} {'long header text ' * rng.choice([0, 1, 4])}>x")
        seq, width = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 30, 200]))), rng.choice([1, 7, 60, 10_000])
        lines += [seq[i : i + width] + rng.choice(["", "", "\r"]) for i in range(0, len(seq), width)] + [""] * rng.choice([0, 0, 2])
    text = "\n".join(lines) + rng.choice(["", "\n"])
    (tmp_path / "x.fa").write_text(text)
    return str(tmp_path / "x.fa")


@pytest.mark.parametrize("seed, block", [(0, 1), (1, 13), (2, 64), (3, 7), (4, 1 << 20), (5, 50)])
def test_chunks(spark, tmp_path, seed, block):
    path = written(tmp_path, seed, 4 if block == 1 else 7)
    whole = read_fasta(spark, path).withColumn("ref_id", F.regexp_extract("name", r"s(\d+)", 1).cast("long"))
    for size, margin in ((16, 0), (16, 5), (64, 64)):
        want = sorted(map(tuple, reference_chunks(whole, size, margin).select("ref_id", "chunk", "chunk_start", "seq").collect()))
        got = sorted(map(tuple, fasta_chunks(spark, path, size, margin, block).select("record", "chunk", "chunk_start", "seq").collect()))
        assert got == want
    index = sorted(map(tuple, fasta_index(spark, path, block).select("record", "name", "length").collect()))
    assert index == sorted(map(tuple, whole.select("ref_id", "name", F.length("seq")).collect()))


def test_many_files_and_none(spark, tmp_path):
    (tmp_path / "a.fa").write_text("no header\n>a\nACGT\n")
    (tmp_path / "b.fa").write_text(">b\n>c x\nTT\nT")
    (tmp_path / "c.fa").write_text("")
    got = {(r["file"][-4], r["record"], r["seq"]) for r in fasta_chunks(spark, str(tmp_path), 100, block=5).collect()}
    assert got == {("a", 0, "ACGT"), ("b", 0, ""), ("b", 1, "TTT")}


def test_a_long_line_is_many_tasks(spark, tmp_path):
    """A sequence of one line is read by as many tasks as it has blocks; no task reads more than its own and a chunk."""
    n = 3_000_000
    seq = ("ACGTTGCA" * (n // 8))[:n]
    (tmp_path / "long.fa").write_text(">long\n" + seq + "\n>next\nAC\n")
    rows = fasta_chunks(spark, str(tmp_path / "long.fa"), 1 << 14, block=1 << 18).withColumn("task", F.spark_partition_id())
    found = rows.filter("record = 0").groupBy("task").count().collect()
    assert len(found) >= 6 and max(r["count"] for r in found) < 0.5 * n / (1 << 14)
    assert "".join(r["seq"] for r in rows.filter("record = 0").orderBy("chunk").collect()) == seq
