"""Least-recently-used caches replayed from a log of operations, in batch and as a stream."""

from __future__ import annotations

import json
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "cache_id string, seq long, op string, key long, result long"


class Cache:
    """``get`` gives -1 on a miss; both operations refresh; beyond the capacity the least recently used key goes."""

    def __init__(self, capacity: int, entries: list | None = None) -> None:
        if capacity <= 0:
            raise ValueError("capacity is at least 1")
        self.capacity, self.entries = capacity, OrderedDict(entries or [])

    def get(self, key: int) -> int:
        if key not in self.entries:
            return -1
        self.entries.move_to_end(key)
        return self.entries[key]

    def put(self, key: int, value: int) -> None:
        self.entries[key] = value
        self.entries.move_to_end(key)
        if len(self.entries) > self.capacity:
            self.entries.popitem(last=False)

    def replay(self, ops: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in ops.sort_values("seq", kind="stable").itertuples(index=False):
            if r.op == "put":
                self.put(int(r.key), int(r.value))
            out.append((str(r.cache_id), int(r.seq), r.op, int(r.key), self.get(int(r.key)) if r.op == "get" else None))
        frame = pd.DataFrame(out, columns=["cache_id", "seq", "op", "key", "result"])
        return frame.astype({"result": "Int64"})


def replay(log: DataFrame, capacity: int) -> DataFrame:
    """(cache_id, seq, op, key, result) from (cache_id, seq, op, key, value): each cache's log is one ordered task."""

    def run(ops: pd.DataFrame) -> pd.DataFrame:
        return Cache(capacity).replay(ops)

    return log.groupBy("cache_id").applyInPandas(run, _OUT)


def replay_stream(log: DataFrame, capacity: int) -> DataFrame:
    """The same over a stream: the state of a cache is its entries, in order of use. Within a trigger ops are ordered by seq."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        cache = Cache(capacity, [tuple(x) for x in json.loads(state.get[0])] if state.exists else None)
        yield cache.replay(pd.concat(list(frames)))
        state.update((json.dumps(list(cache.entries.items())),))

    return log.groupBy("cache_id").applyInPandasWithState(run, _OUT, "entries string", "append", GroupStateTimeout.NoTimeout)
