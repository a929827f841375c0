"""Mates on a stream: reads wait for the other segments of their template, and go on with their mates' places.

State is kept by template (RocksDB, as transformWithState needs): the reads that came, until the template is whole or the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _side(flags: int) -> int:
    """What a read's flags say of it to its mate: unmapped, reverse."""
    return (8 if flags & 4 else 0) | (32 if flags & 16 else 0)


def associated(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Reads of one template with their mates' places and flags; the rules of operators.associate_mates."""
    by_number = {r["rec_no"]: r for r in rows}
    behind = {r["mate_no"]: r for r in reversed(rows) if r["mate_no"] is not None}
    out = []
    for r in rows:
        flags, place = r["flags"], None
        ahead, back = by_number.get(r["mate_no"]) if r["mate_no"] is not None else None, behind.get(r["rec_no"])
        if ahead is not None:
            flags |= 1 | _side(ahead["flags"])
            place = ahead
        if back is not None:
            flags |= _side(back["flags"])
            if r["mate_no"] is None and r["next_sequence_id"] is None:
                place = back
        out.append(r | {"flags": flags} | ({"next_sequence_id": place["sequence_id"], "next_start": place["start"]} if place else {}))
    return out


class MateProcessor(StatefulProcessor):
    """One template: its reads by number, and whether they have gone on."""

    def __init__(self, schema: T.StructType, key: list[str], segments: int | None, wait_ms: int, event_time: str):
        self.schema, self.key, self.segments, self.wait_ms, self.event_time = schema, key, segments, wait_ms, event_time
        self.held = T.StructType([f for f in schema.fields if f.name not in key])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getListState("reads", self.held)
        self.gone = handle.getValueState("gone", T.StructType([T.StructField("gone", T.BooleanType())]))

    def _frame(self, key: tuple, rows: list[dict[str, Any]]) -> pd.DataFrame:
        rows = [dict(zip(self.key, key, strict=True)) | r for r in associated(rows)]
        return pd.DataFrame({f.name: pd.Series([r[f.name] for r in rows], dtype=object) for f in self.schema.fields})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.held.fieldNames()
        held = [dict(zip(names, r, strict=True)) for r in self.reads.get()] if self.reads.exists() else []
        known, came = {r["rec_no"] for r in held}, []
        for frame in rows:
            for values in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None):
                row = {f.name: _plain(v, f.dataType) for f, v in zip(self.held.fields, values, strict=True)}
                if row["rec_no"] not in known:  # of a read that comes again the first stays
                    known.add(row["rec_no"])
                    came.append(row)
        if not came or self.gone.exists():
            return
        if not held:
            self.handle.registerTimer(int(pd.Timestamp(came[0][self.event_time]).timestamp() * 1000) + self.wait_ms)
        self.reads.appendList([tuple(r[n] for n in names) for r in came])
        held += came
        if self.segments is not None and len(held) >= self.segments:
            self.gone.update((True,))
            yield self._frame(key, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.gone.exists() and self.reads.exists():
            names = self.held.fieldNames()
            yield self._frame(key, [dict(zip(names, r, strict=True)) for r in self.reads.get()])
        self.reads.clear()
        self.gone.clear()

    def close(self) -> None:
        pass


def _plain(v: Any, kind: T.DataType) -> Any:
    """A value of a pandas frame as the state takes it; whole numbers beside nulls have come as floats."""
    if v is None or isinstance(kind, T.IntegralType):
        return None if v is None else int(v)
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def stream_mates(reads: DataFrame, key: list[str], event_time: str, wait: str, segments: int | None = 2) -> DataFrame:
    """Streaming reads with their mates' places and flags, as `associate_mates` gives them for the whole.

    reads: rec_no and mate_no within `key`, flags, sequence_id, start, next_sequence_id, next_start, a timestamp `event_time`, and any columns of
    plain types. A template whose `segments` reads are there goes on at once (None: never before its time); what has not gone when the watermark
    is `wait` past its first read goes on as it is, a lone read without its mate's place. A read that comes again before that is dropped, as
    is one that comes after the watermark. Sets the session's state store, as only that one has timers and lists.
    """
    spark = reads.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    order = [c for c in reads.columns if c not in key]
    schema = T.StructType([*(reads.schema[k] for k in key), *(T.StructField(c, reads.schema[c].dataType) for c in order)])
    rows = reads.withWatermark(event_time, wait)
    out = rows.groupBy(*key).transformWithStateInPandas(MateProcessor(schema, key, segments, wait_ms, event_time), schema, "Append", "EventTime")
    return out.select(*[F.col(c) for c in reads.columns])
