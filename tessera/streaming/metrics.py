"""Incremental variants: windowed metrics with late rows, moving averages by count, a trigger that fires once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def moving_average(steps: DataFrame, n: int = 50) -> DataFrame:
    """Mean of the newest n values of each run, one row out for each row in; columns run, step, value."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        for pdf in frames:
            out = []
            for step, value in sorted(zip(pdf["step"], pdf["value"])):
                ring = [*ring, float(value)][-n:]
                out.append((key[0], int(step), sum(ring) / len(ring)))
            yield pd.DataFrame(out, columns=["run", "step", "mean"])
        state.update((ring,))

    return steps.groupBy("run").applyInPandasWithState(run, "run string, step long, mean double", "ring array<double>", "append", GroupStateTimeout.NoTimeout)


def step_trigger(steps: DataFrame, at: int) -> DataFrame:
    """One row for each run when its step first reaches `at`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired = state.exists and state.get[0]
        best = max((int(pdf["step"].max()) for pdf in frames if len(pdf)), default=-1)
        if not fired and best >= at:
            yield pd.DataFrame([(key[0], best)], columns=["run", "step"])
            fired = True
        state.update((bool(fired),))

    return steps.groupBy("run").applyInPandasWithState(run, "run string, step long", "fired boolean", "append", GroupStateTimeout.NoTimeout)


def late_by_one(steps: DataFrame) -> DataFrame:
    """The metrics of a step come out when the next step of its run comes in; columns run, step, value. The last step of
    a run stays in the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for pdf in frames:
            out = []
            for step, value in sorted(zip(pdf["step"], pdf["value"])):
                if held is not None:
                    out.append((key[0], *held))
                held = (int(step), float(value))
            yield pd.DataFrame(out, columns=["run", "step", "value"])
        state.update(held)

    return steps.groupBy("run").applyInPandasWithState(run, "run string, step long, value double", "step long, value double", "append", GroupStateTimeout.NoTimeout)


def time_trigger(steps: DataFrame, after: str) -> DataFrame:
    """One row for each run once its rows, by their own time, reach over more than `after` (an interval as in `90 seconds`);
    columns run, ts."""
    limit = pd.Timedelta(after)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, fired = state.get if state.exists else (None, False)
        for pdf in frames:
            for ts in sorted(pdf["ts"]):
                first = ts if first is None else min(pd.Timestamp(first), ts)
                if not fired and ts - pd.Timestamp(first) >= limit:
                    fired = True
                    yield pd.DataFrame([(key[0], ts)], columns=["run", "ts"])
        state.update((first, fired))

    return steps.groupBy("run").applyInPandasWithState(run, "run string, ts timestamp", "first timestamp, fired boolean", "append", GroupStateTimeout.NoTimeout)


def heartbeats(spark: SparkSession, run: str, each_second: int = 1) -> DataFrame:
    """An endless stream of (run, ts, alive)."""
    return spark.readStream.format("rate").option("rowsPerSecond", each_second).load().select(F.lit(run).alias("run"), F.col("timestamp").alias("ts"), F.lit(True).alias("alive"))


def resumable(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is new since the last call as Parquet, each row once; the place is kept in the checkpoint folder."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
