"""Gaps of a stream of records: state by station and channel that outlives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_GAP = "user_id bigint, event_type string, start timestamp, stop timestamp, seconds double"


def gaps(events: DataFrame, longer: float, most: int | None = None) -> DataFrame:
    """Start, stop and seconds of the gaps of over `longer` seconds between records of a station's channel, as they come.

    The state of a channel is the time of its last record and the number of records; after `most` records it is finished and what still comes is passed over.
    A record from before the last one doesn't make a gap; batches should follow in time. A query that starts again from its checkpoint goes on where it was.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        times = sorted(t for p in parts for t in p["ts"])
        out = []
        for t in times:
            if most is not None and n >= most:
                break
            now = int(t.value // 1000)
            if last is not None and now - last > longer * 1e6:
                out.append((*key, pd.Timestamp(last, unit="us"), pd.Timestamp(now, unit="us"), (now - last) / 1e6))
            last, n = now if last is None else max(last, now), n + 1
        state.update((last, n))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "start", "stop", "seconds"])

    return events.select("user_id", "event_type", "ts").groupBy("user_id", "event_type").applyInPandasWithState(run, _GAP, "last bigint, n bigint", "append", GroupStateTimeout.NoTimeout)
