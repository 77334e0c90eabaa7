"""Structured Streaming forms of the rate limiter and the budget (an extension: the batch forms are windows)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def paced(stream: DataFrame, interval_us: int) -> DataFrame:
    """(gate, id, us, release_us); each gate's last release is kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values(["us", "id"])
            out = []
            for us in f["us"]:
                last = us if last is None else max(us, last + interval_us)
                out.append(last)
            yield pd.DataFrame({"gate": key[0], "id": f["id"].values, "us": f["us"].values, "release_us": out})
        if last is not None:
            state.update((int(last),))

    return stream.groupBy("gate").applyInPandasWithState(step, "gate long, id long, us long, release_us long", "last long", "append", GroupStateTimeout.NoTimeout)
