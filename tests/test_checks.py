"""The region index, mate pointer faults and slice checksums against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import operators as O
from readloom.model import MalformedInputError
from readloom.sources import reference_chunks


@pytest.mark.parametrize("n", [0, 1, 2, 17, 300, 5000])
def test_interval_index(n):
    rng = np.random.default_rng(n)
    seq, start = rng.integers(0, 3, n), rng.integers(0, 2000, n)
    end = start + np.where(rng.random(n) < 0.05, 1500, rng.integers(1, 30, n))
    q_seq, q_start = rng.integers(0, 4, 200), rng.integers(-10, 2100, 200)
    q_end = q_start + rng.integers(1, 40, 200)
    got = list(zip(*(x.tolist() for x in O.IntervalIndex(seq, start, end).overlapping(q_seq, q_start, q_end))))
    assert got == [(i, j) for i in range(200) for j in np.flatnonzero((seq == q_seq[i]) & (start < q_end[i]) & (end > q_start[i])).tolist()]


@pytest.mark.parametrize("most", [1 << 18, 5])
def test_region_join(spark, most):
    rng = random.Random(3)
    reads = [(i, rng.choice([0, 1, None]), rng.choice([rng.randint(0, 500), None]), rng.choice([None, 0, 25])) for i in range(300)] + [(7, 0, 10, 5)] * 3
    regions = [(f"r{k}", rng.choice([0, 1, 2, None]), a := rng.randint(0, 500), a + rng.choice([-1, 0, 1, 40, 400])) for k in range(40)] + [("r0", 0, 5, 20)]
    a = spark.createDataFrame(reads, "id long, sequence_id int, start int, length_on_ref int").withColumn("hit_", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(regions, "region_id string, sequence_id int, region_start int, region_end int")
    got = O.region_join(a, b, most=most, width=64)
    assert got.columns == ["id", "sequence_id", "start", "length_on_ref", "hit_", "region_id", "region_start", "region_end"]
    want = sorted((i, r, x) for i, s, at, n in reads for r, t, x, y in regions if s is not None and at is not None and s == t and x < y and at < y and at + max(1, n or 1) > x)
    assert sorted((r["id"], r["region_id"], r["region_start"]) for r in got.collect()) == want
    assert O.region_join(a, b.limit(0)).count() == 0 and O.region_join(a.limit(0), b).count() == 0


def faults(spark, pointers):
    rows = [(s, r, m) for s, ms in pointers.items() for r, m in enumerate(ms)]
    return spark.createDataFrame(rows, "slice int, rec_no int, mate_no int")


def test_mate_faults(spark):
    pointers = {
        0: [1, None, 3, None], 1: [1, 2, 1], 2: [1, 1], 3: [5, None], 4: [1, 9], 5: [2, 2, None], 6: [None, 0, 1], 7: [3, 0, 1, 2], 8: [0], 9: [-4, 0],
    }
    got = {(r["slice"], r["rec_no"], r["fault"]) for r in O.mate_faults(faults(spark, pointers), ["slice"]).collect()}
    cyclic = {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (7, 0), (7, 1), (7, 2), (7, 3), (8, 0)}
    claimed = {(1, 0), (1, 2), (2, 0), (2, 1), (5, 0), (5, 1)}
    assert got == {(*x, "cyclic") for x in cyclic} | {(*x, "claimed twice") for x in claimed} | {(4, 1, "dangling"), (9, 0, "dangling")}


def test_mate_faults_against_walks(spark):
    rng = random.Random(9)
    pointers = {s: [rng.choice([None, rng.randint(0, n + 1), r + 1]) for r in range(n)] for s, n in ((s, rng.randint(1, 9)) for s in range(80))}
    got = {(r["slice"], r["rec_no"]) for r in O.mate_faults(faults(spark, pointers), ["slice"]).filter("fault = 'cyclic'").collect()}
    want = set()
    for s, ms in pointers.items():
        for r in range(len(ms)):
            at, steps = r, 0
            while at is not None and at < len(ms) and steps <= len(ms):
                at, steps = ms[at], steps + 1
            if steps > len(ms):
                want.add((s, r))
    assert got == want


@pytest.mark.parametrize("bad, fault", [([1, 2, 1], "claimed twice|cyclic"), ([1, 1], "claimed twice|cyclic"), ([0], "cyclic"), ([1, 7, None], "dangling"), ([2, 2, None], "claimed twice"), ([1, 0], "cyclic")])
def test_malformed_mates_raise(spark, bad, fault):
    with pytest.raises(MalformedInputError, match=fault) as e:
        O.checked_mates(faults(spark, {3: [1, None], 4: bad}), ["slice"])
    assert "slice 4" in str(e.value) and "record" in str(e.value)


def test_wellformed_mates_pass(spark):
    reads = faults(spark, {0: [1, None], 1: [2, 3, 4, None, None], 2: [None], 3: [9, None]})
    assert O.checked_mates(reads, ["slice"]) is reads
    assert O.mate_faults(reads.limit(0), ["slice"]).count() == 0


def test_slice_checksums(spark):
    rng = random.Random(4)
    seqs = {k: "".join(rng.choice("ACGTacgtn*\x7f ") for _ in range(n)) for k, n in ((0, 1000), (1, 64), (2, 0))}
    md5 = lambda t: hashlib.md5("".join(c for c in t.upper() if "!" <= c <= "~").encode()).hexdigest()
    slices = [(i, k, a := rng.randint(0, len(seqs[k])), b := rng.randint(a, len(seqs[k])), md5(seqs[k][a:b])) for i, k in enumerate(rng.choice([0, 1]) for _ in range(60))]
    bad = slices[0][:1] + (0, 10, 900, md5(seqs[0][10:400] + "T" + seqs[0][401:900].replace("A", "C", 1)))
    more = [bad, (100, 0, 0, 500, None), (101, 0, 0, 500, "0" * 32), (102, 0, 900, 1200, "ab"), (103, 2, 0, 5, "ab"), (104, 9, 0, 5, "ab"), (105, 0, 5, 5, "ab")]
    df = spark.createDataFrame(more + slices[1:], "slice int, ref_id int, span_start int, span_end int, md5 string").withColumn("chunk", F.lit("clash"))
    chunks = reference_chunks(spark.createDataFrame(list(seqs.items()), "ref_id int, seq string"), 16)
    got = {r["slice"]: r["md5_ok"] for r in O.slice_checksums(df, chunks, 16, ["slice"]).collect()}
    assert all(got[s[0]] for s in slices[1:]) and not got[0] and got[0] is not None
    assert [got[k] for k in range(100, 106)] == [True, True, None, None, None, True]
    assert O.slice_checksums(df.limit(0), chunks, 16, ["slice"]).count() == 0
