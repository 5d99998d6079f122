"""The ledger as a stream: changes and decisions arrive in batches and are merged by signature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from morphloom.operators.ledger import FILLED, route
from morphloom.session import scratch

ROW = "op string, key string, batches bigint, confidence double, rounds_seen bigint, status string, locked boolean, decided_by string, provenance array<string>, " + ", ".join(f"{f} string" for f in FILLED)
STATE = "batches bigint, confidence double, rounds_seen bigint, status string, locked boolean, decided_by string, provenance array<string>, " + ", ".join(f"{f} string" for f in FILLED)


def _given(value: object) -> bool:
    return value is not None and value == value and value != ""


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One signature's new changes and decisions, in order, upon its state. The rules are those of ``merge_changes``."""
    batches, sure, rounds, status, locked, by, sources, *fill = state.get if state.exists else (0, None, 0, None, False, None, [], *[None] * len(FILLED))
    sources, fill = list(sources), list(fill)
    for event in pd.concat(list(frames)).sort_values("ordinal", kind="stable").to_dict("records"):
        if _given(event["decision"]):
            if rounds:
                status, locked, by = ("accepted" if event["decision"] == "accept" else "rejected"), True, event["by"] if _given(event["by"]) else None
            continue
        rounds += 1
        given = float(event["confidence"]) if _given(event["confidence"]) else None
        if rounds == 1:
            sure, status = given, "deferred"
        elif not locked:
            sure = max(sure or 0.0, given or 0.0)
        if not locked:
            fill = [old if _given(old) else (event[f] if _given(event[f]) else None) for old, f in zip(fill, FILLED, strict=True)]
        if _given(event["source"]):
            sources.append(event["source"])
    if not rounds:
        return
    state.update((batches + 1, sure, rounds, status, locked, by, sources, *fill))
    yield pd.DataFrame([[*key, batches + 1, sure, rounds, status, locked, by, sources, *fill]], columns=[c.split()[0] for c in ROW.split(", ")])


def ledger_stream(events: DataFrame) -> DataFrame:
    """The rows of ``merge_changes`` that change with each batch, as a stateful stream in update mode.

    events: a stream of (op, key, ordinal, confidence, source, decision, by, and the
    columns of ``FILLED``); an event with a decision is one, any other is a change.
    The state is one row for each signature. ``batches`` counts a row's updates, so
    its newest version is the one with the most (``newest``).
    """
    missing = [F.lit(None).cast("string").alias(f) for f in FILLED if f not in events.columns]
    typed = events.select("op", "key", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("confidence").cast("double").alias("confidence"), "source", "decision", "by", *[f for f in FILLED if f in events.columns], *missing)
    return typed.groupBy("op", "key").applyInPandasWithState(_advance, ROW, STATE, "update", GroupStateTimeout.NoTimeout)


def newest(updates: DataFrame) -> DataFrame:
    """The ledger from the updates of ``ledger_stream``: the newest version of each row, routed."""
    columns = [c for c in updates.columns if c not in ("op", "key", "batches")]
    last = updates.groupBy("op", "key").agg(F.max_by(F.struct(*columns), "batches").alias("x"))
    return route(last.select("op", "key", "x.*"))


def windowed_counts(ops: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, op, n): changes by time window; what is later than ``late`` is dropped. An addition of this engine."""
    counted = ops.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "op", "n")


def to_table(stream: DataFrame, name: str, mode: str = "update") -> StreamingQuery:
    """Run a stream to its present end into the in-memory table ``name``; its checkpoint, in the shared folder, is of this run only."""
    where = scratch(stream.sparkSession, f"stream-{name}")
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
