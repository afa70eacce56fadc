"""An answer cache with expiry for a driver, and simulated over a stream of look-ups."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Entries held, and seconds until one expires.
CAPACITY, TTL = 256, 7200


class TtlCache:
    """Least recently used entries go first; a read refreshes an entry's place but not its expiry;
    writing an entry that is there keeps its place."""

    def __init__(self, capacity: int = CAPACITY, ttl: float = TTL):
        self.capacity, self.ttl, self.entries = capacity, ttl, OrderedDict()

    def get(self, key, now: float):
        found = self.entries.pop(key, None)
        if found is None or found[1] <= now:
            return None
        self.entries[key] = found
        return found[0]

    def put(self, key, value, now: float) -> None:
        self.entries[key] = (value, now + self.ttl)
        if len(self.entries) > self.capacity:
            self.entries.popitem(last=False)


def stream_hits(log: DataFrame, *, key: str = "key", ts: str = "ts", ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit) of a streamed log: each key's state is its entry's expiry, which event time
    drops once the watermark has passed it."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(ts)
        until, out = (state.get[0] if state.exists else float("-inf")), []
        for t in rows[ts]:
            now = t.timestamp()
            out.append((k[0], t, now < until))
            until = until if now < until else now + ttl
        state.update((until,))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "hit"])

    rows = log.select(key, ts).withWatermark(ts, late)
    kind = log.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {ts} timestamp, hit boolean", "until double", "append", "EventTimeTimeout")
