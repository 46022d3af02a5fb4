"""Streams of point measurements into cubes, and exponentially weighted means as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def windowed_cube(events: DataFrame, time: str, value: str, cell: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(time, cell, v, n) of tumbling windows; rows later than the watermark are dropped. Works on tables, too."""
    made = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *cell).agg(F.avg(value).alias("v"), F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("time"), *cell, "v", "n")


def stream_ewm(events: DataFrame, time: str, value: str, cell: str, span: int) -> DataFrame:
    """(cell, time, value, ewm) of a stream: each cell's last mean is its state; rows of a batch go in order of time."""
    ship(events.sparkSession)
    a = 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("time")
        out = []
        for x in rows["value"]:
            if not pd.isna(x):
                y = float(x) if y is None else a * float(x) + (1 - a) * y
            out.append(y)
        if y is not None:
            state.update((y,))
        yield rows.assign(ewm=pd.Series(out, index=rows.index, dtype="float64"))[["cell", "time", "value", "ewm"]]

    need = events.select(F.col(cell).cast("string").alias("cell"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"))
    return need.groupBy("cell").applyInPandasWithState(step, "cell string, time timestamp, value double, ewm double", "y double", "append", GroupStateTimeout.NoTimeout)
