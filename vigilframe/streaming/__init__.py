"""Queries over streams: the compiled filter and aggregation on windows, frequency rules, ordered sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilframe.plans.compile import Options, having, predicate
from vigilframe.plans.fields import Binding
from vigilframe.plans.query import Query, QueryError, seconds


def windowed_query(events: DataFrame, q: Query, binding: Binding, time: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """A filter-and-aggregate query on a stream: one result per window of the query's duration and key, late events up to ``late``.

    Distinct counts are approximate, as a stream can't keep all values.
    """
    if not q.aggregates or not q.time_window:
        raise QueryError("a windowed query needs an aggregation and a time window")
    df = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    if (p := predicate(q.filter, binding, Options())) is not None:
        df = df.filter(p)
    a = q.aggregation
    of = binding.column(a.field) if a.field else None
    value = F.count(F.lit(1)) if a.function == "count" else F.approx_count_distinct(of) if a.function == "distinct_count" else getattr(F, a.function)(of)
    width = f"{q.time_window.seconds} seconds"
    out = df.groupBy(F.window("_at", width, slide or width).alias("window"), *(binding.column(k).alias(k) for k in a.group_by)).agg(value.alias(a.output))
    out = having(out, q.threshold, a) if q.threshold else out
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *a.group_by, a.output)


def session_counts(events: DataFrame, key: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events of a key per session window."""
    df = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return df.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def two_step_sequence(first: DataFrame, second: DataFrame, key: str, time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a first and a later second event of one key within a gap, as an interval join of two streams."""
    a = first.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("step_1_time")).withWatermark("step_1_time", late).alias("a")
    b = second.select(F.col(key).alias("k2"), F.col(time).cast("timestamp").alias("step_2_time")).withWatermark("step_2_time", late).alias("b")
    span = F.expr(f"interval {seconds(within)} seconds")
    return a.join(b, (F.col("key") == F.col("k2")) & (F.col("step_2_time") > F.col("step_1_time")) & (F.col("step_2_time") <= F.col("step_1_time") + span)).select("key", "step_1_time", "step_2_time")


class SequenceProcessor(StatefulProcessor):
    """Longest chains of steps per key: for each step the times at which the steps up to it were met.

    Events of a batch are taken in time order; one that comes in a later batch, though before others already
    taken, still continues chains that are open at its time.  What no event after the watermark can continue is dropped, by a timer
    also for keys without further events.
    """

    def __init__(self, gaps: list[int]) -> None:
        self.gaps = gaps  # seconds between a step and the one before; the first is unused

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.met = handle.getListState("met", "step int, first timestamp, last timestamp")

    def _ends(self, chain: tuple) -> pd.Timestamp:
        return chain[2] + pd.Timedelta(seconds=self.gaps[chain[0]])

    def _keep(self, chains: set[tuple], timer_values) -> None:
        watermark = pd.Timestamp(timer_values.getCurrentWatermarkInMs(), unit="ms")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        left = sorted(c for c in chains if self._ends(c) >= watermark)
        if left:
            self.met.put(left)
            self.handle.registerTimer(int(max(map(self._ends, left)).timestamp() * 1000) + 1)
        else:
            self.met.clear()

    def _open(self) -> set[tuple]:
        return {(s, pd.Timestamp(f), pd.Timestamp(x)) for s, f, x in self.met.get()} if self.met.exists() else set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, found = self._open(), []
        events = pd.concat(list(rows)).sort_values(["at", "step"])
        by_step: dict[int, set[tuple]] = {}
        for c in open_:
            by_step.setdefault(c[0], set()).add(c)
        for step, at in zip(events["step"], events["at"]):
            if step == 1:
                by_step.setdefault(1, set()).add((1, at, at))
                continue
            # chains of one step lower only; equal ones are one
            for chain in sorted(by_step.get(step - 1, ())):
                if chain[2] < at <= self._ends(chain):
                    if step == len(self.gaps):
                        found.append((key[0], chain[1], at))
                    else:
                        by_step.setdefault(step, set()).add((step, chain[1], at))
        self._keep({c for s, own in by_step.items() if s < len(self.gaps) for c in own}, timerValues)
        yield pd.DataFrame(found, columns=["key", "started", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._open(), timerValues)
        yield pd.DataFrame([], columns=["key", "started", "ended"])

    def close(self) -> None:
        pass


def stateful_sequence(steps: DataFrame, gaps: list[str], late: str = "10 minutes") -> DataFrame:
    """Chains over any number of steps; ``steps`` has key string, step int (from 1) and at timestamp."""
    processor = SequenceProcessor([0, *map(seconds, gaps)])
    return steps.withWatermark("at", late).groupBy("key").transformWithStateInPandas(processor, "key string, started timestamp, ended timestamp", "Append", "EventTime")
