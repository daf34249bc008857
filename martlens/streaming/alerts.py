"""Alerts that hold for a time, on a stream of samples: the same as operators.alerts over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "name string, since timestamp, fired_at timestamp"
#: The open run, whether it has fired, and samples that the watermark has not passed.
_STATE = "since long, fired boolean, waiting array<long>, holding array<boolean>"


def sustained_stream(samples: DataFrame, hold_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(name, since, fired_at) as soon as an alert fires; samples has (name string, ts timestamp, holds boolean).

    Samples wait until the watermark has passed them, so those that come late by less than ``late`` are taken in order;
    later ones are dropped. A timer at a name's earliest waiting sample works it off when no more samples of that name
    come. What is kept for a name is its open run and the samples of the last ``late``.
    """
    hold = hold_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired, waiting, holding = state.get if state.exists else (None, False, [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        pending = dict(zip(waiting, holding, strict=True))
        for batch in batches:
            for ts, holds in zip(batch["ts"].to_numpy("datetime64[us]").astype("int64"), batch["holds"], strict=True):
                if ts >= mark or not state.exists:
                    pending[int(ts)] = bool(holds) and not pd.isna(holds) and pending.get(int(ts), True)
        found = []
        for ts in sorted(t for t in pending if t < mark):
            if not pending.pop(ts):
                since, fired = None, False
                continue
            since = ts if since is None else since
            if not fired and ts - since >= hold:
                fired = True
                found.append((key[0], pd.Timestamp(since, unit="us"), pd.Timestamp(ts, unit="us")))
        order = sorted(pending)
        state.update((since, fired, order, [pending[t] for t in order]))
        if order:
            state.setTimeoutTimestamp(max(order[0] // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(found, columns=["name", "since", "fired_at"])

    rows = samples.select("name", F.col("ts").cast("timestamp").alias("ts"), "holds").where("ts is not null").withWatermark("ts", late)
    return rows.groupBy("name").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
