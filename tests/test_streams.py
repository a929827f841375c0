"""Mates on a stream against mates of the whole table."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from readloom.operators import associate_mates
from readloom.streaming import stream_mates

SCHEMA = "name string, rec_no int, mate_no int, flags int, sequence_id int, start int, next_sequence_id int, next_start int, at timestamp"
T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, segments=2, wait="10 minutes"):
    """Each batch of rows is a micro-batch, in order."""
    source, sink = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"b={k}"))
        if k == 0:
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
            mated = stream_mates(stream, ["name"], "at", wait, segments)
        mated.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(SCHEMA).parquet(str(sink))


@pytest.fixture(scope="module")
def provider(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def later(minutes):
    return T0 + dt.timedelta(minutes=minutes)


END = [("end", 0, None, 0, 0, 0, None, None, later(500))]


def test_stream_equals_the_whole(spark, tmp_path, provider):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        n = rng.choice([1, 2, 2, 3])
        rows += [(f"t{k}", i, i + 1 if i + 1 < n else None, rng.choice([0, 4, 16, 65, 129]), rng.randint(0, 2), rng.randint(0, 999), None, None, later(rng.randint(0, 5))) for i in range(n)]
    rng.shuffle(rows)
    got = run(spark, tmp_path, [rows[::2], rows[1::2], END], segments=None)
    want = associate_mates(spark.createDataFrame(rows, SCHEMA), ["name"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_pairs_go_at_once_and_lone_reads_after_the_watermark(spark, tmp_path, provider):
    pair = [("p", 0, 1, 16, 1, 10, None, None, later(0)), ("p", 1, None, 4, 1, 30, None, None, later(2))]
    lone = [("l", 0, 1, 0, 2, 50, None, None, later(0))]
    assert {(r["name"], r["rec_no"], r["flags"], r["next_start"]) for r in run(spark, tmp_path, [[pair[0], *lone], [pair[1]]]).collect()} == {("p", 0, 16 | 1 | 8, 30), ("p", 1, 4 | 32, 10)}
    more = run(spark, tmp_path / "more", [[pair[0], *lone], [pair[1]], END])
    assert {(r["name"], r["rec_no"], r["next_start"]) for r in more.collect()} == {("p", 0, 30), ("p", 1, 10), ("l", 0, None)}


def test_repeated_and_late_reads(spark, tmp_path, provider):
    a, b = ("p", 0, 1, 0, 1, 10, None, None, later(0)), ("p", 1, None, 0, 1, 30, None, None, later(1))
    again, late = ("p", 0, 1, 0, 1, 77, None, None, later(2)), ("q", 0, None, 0, 1, 5, None, None, later(0))
    got = run(spark, tmp_path, [[a, a], [again], [b], [again], [("x", 0, None, 0, 0, 0, None, None, later(60))], [late], END])
    assert sorted((r["name"], r["rec_no"], r["start"]) for r in got.collect()) == [("p", 0, 10), ("p", 1, 30), ("x", 0, 0)]
