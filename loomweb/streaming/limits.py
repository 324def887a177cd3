"""A token bucket for each host as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(requests: DataFrame, rate: float) -> DataFrame:
    """requests: host, seq, at (seconds).  host, seq, at and admitted_at; the bucket lasts from batch to batch.

    Within a batch requests of a host are taken by time; the state is (tokens, time of the last refill).
    """
    capacity = max(rate, 1.0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for at in rows["at"]:
            now = at if last is None else max(at, last)
            tokens = capacity if last is None else min(capacity, tokens + (now - last) * rate)
            if tokens < 1:
                now, tokens = now + (1 - tokens) / rate, 1.0
            tokens, last = tokens - 1, now
            out.append(now)
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "at": rows["at"].to_numpy(), "admitted_at": out})

    return requests.groupBy("host").applyInPandasWithState(
        run, "host string, seq long, at double, admitted_at double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )
