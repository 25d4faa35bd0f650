"""Exponentially weighted variance of a stream of prices, kept per series; an extension of the batch operator.

Rows are taken in event-time order inside each micro-batch, and micro-batches as they come. Nothing waits for the
watermark and nothing is dropped: a row that comes after a batch with later ones enters the filter where it arrives, as a
filter cannot go back. Sources must deliver a series in order for the stream to equal the batch operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "series string, ts timestamp, price double, log_return double, variance double"
_STATE = "price double, variance double"


def advance(rows: pd.DataFrame, price: float | None, variance: float, decay: float) -> tuple[pd.DataFrame, float | None, float]:
    """Rows in order with log_return and the variance forecast before each; prices that are not positive change nothing."""
    returns, forecasts = [], []
    for p in rows["price"]:
        r = math.log(p / price) if p is not None and p > 0 and price else None
        returns.append(r)
        forecasts.append(variance)
        if r is not None:
            variance = decay * variance + (1 - decay) * r * r
        if p is not None and p > 0:
            price = p
    return rows.assign(log_return=returns, variance=forecasts), price, variance


def ewma_stream(prices: DataFrame, seed: float, decay: float = 0.94, delay: str = "1 hour") -> DataFrame:
    """(series, ts, price, log_return, variance) for a streaming (series, ts, price); append mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, variance = state.get if state.exists else (None, seed)
        rows = pd.concat(list(batches)).sort_values("ts")
        out, price, variance = advance(rows, price, variance, decay)
        state.update((price, variance))
        yield out[["series", "ts", "price", "log_return", "variance"]]

    clean = prices.withWatermark("ts", delay).select("series", "ts", F.col("price").cast("double").alias("price"))
    return clean.groupBy("series").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
