"""State of requests, kept by Spark's stateful processors: counts of actions in the order of events.

Events may come in any order within the watermark. The open ones of most requests are few and lie in one value; what
passes BLOCK events moves to map state under (bucket of event time, block of event numbers), at most BLOCK in each, so
that a busy request never has more than a block and a batch of rows in memory at once; an event that comes twice counts once.
What a run of events does to the counts is a small summary, and the summaries of two neighbouring runs join to one. When
the watermark passes the earliest open bucket, a timer folds all that it has passed into the sealed summary (value
state), and their events go. A request that no event reaches for `idle` of event time is forgotten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

BLOCK = 256
KINDS = {"ask": "a", "verify": "v", "accept": "c"}
OUTPUT = "user_id long, n_events long, asks long, verifies long, accepts long, invalid_accepts long"
SUMMARY = "n long, asks long, verifies long, accepts long, valid long, head string, tail string"
NOTHING = (0, 0, 0, 0, 0, "", "")


def summary(actions: str) -> tuple:
    """Of a run of actions: counts, accepts right after a verify, first and last of the verifies and accepts."""
    turns = [c for c in actions if c in "vc"]
    valid = sum(a == "v" and b == "c" for a, b in zip(turns, turns[1:]))
    return len(actions), actions.count("a"), actions.count("v"), actions.count("c"), valid, (turns or [""])[0], (turns or [""])[-1]


def joined(x: tuple, y: tuple) -> tuple:
    """The summary of two runs, one after the other."""
    counts = [a + b for a, b in zip(x[:5], y[:5])]
    counts[4] += x[6] == "v" and y[5] == "c"
    return (*counts, x[5] or y[5], y[6] or x[6])


class Requests(StatefulProcessor):
    def __init__(self, bucket_ms: int, idle_ms: int):
        self.bucket_ms, self.idle_ms = bucket_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sealed = handle.getValueState("sealed", SUMMARY)
        self.few = handle.getValueState("few", "buckets array<bigint>, ids array<bigint>, acts string")
        self.open = handle.getMapState("open", "bucket long, block long", "ids array<bigint>, acts string")
        self.last = handle.getValueState("last", "ms long, timer long, busy boolean")  # busy: the map is in use

    def _held(self) -> dict[tuple[int, int], str]:
        """Actions of the few open events, by bucket and event."""
        found = self.few.get()
        return dict(zip(zip(found[0], found[1]), found[2])) if found else {}

    def _hold(self, new: dict[tuple[int, int], str]) -> None:
        order = sorted(new)
        self.few.update(([b for b, _ in order], [e for _, e in order], "".join(new[k] for k in order)))

    @staticmethod
    def _blocks(new: dict[tuple[int, int], str]) -> dict[tuple[int, int], dict[int, str]]:
        own: dict[tuple[int, int], dict[int, str]] = {}
        for (bucket, event), act in new.items():
            own.setdefault((bucket, event // BLOCK), {})[event] = act
        return own

    def _keep(self, new: dict[tuple[int, int], str]) -> None:
        for key, own in self._blocks(new).items():
            found = self.open.getValue(key)
            if found:
                own = {**dict(zip(*found)), **own}
            ids = sorted(own)
            self.open.updateValue(key, (ids, "".join(own[i] for i in ids)))

    def _folded(self, new: dict[tuple[int, int], str], entries) -> tuple:
        """The sealed summary joined with those of open events: few ones, and entries (key, value) of the map."""
        start = tuple(self.sealed.get() or NOTHING)
        own, parts = self._blocks(new), {}
        for key, found in entries:
            key = tuple(key)
            more = own.pop(key, None)
            acts = {**dict(zip(*found)), **more} if more else None
            parts[key] = summary("".join(acts[i] for i in sorted(acts)) if acts else found[1])
        if not parts:
            return joined(start, summary("".join(new[k] for k in sorted(new))))
        parts |= {key: summary("".join(acts[i] for i in sorted(acts))) for key, acts in own.items()}
        return reduce(joined, (parts[k] for k in sorted(parts)), start)

    def _row(self, key, total: tuple):
        import pandas as pd

        n, asks, verifies, accepts, valid = total[:5]
        return pd.DataFrame([(key[0], n, asks, verifies, valid, accepts - valid)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        latest, timer, busy = self.last.get() or (0, 0, False)
        new, first = self._held(), None
        for chunk in rows:
            ms = chunk["ts"].astype("datetime64[ms]").astype("int64").clip(lower=0)  # a missing time is the earliest
            latest, earliest = max(latest, int(ms.max())), int(ms.min()) // self.bucket_ms
            first = earliest if first is None else min(first, earliest)
            for bucket, event, action in zip((ms // self.bucket_ms).tolist(), chunk["event_id"].tolist(), chunk["action"].tolist()):
                new[bucket, event] = KINDS.get(action, "o")
            if len(new) > BLOCK:
                self._keep(new)
                new, busy = {}, True
        if first is not None and (not timer or (first + 1) * self.bucket_ms < timer):
            timer = (first + 1) * self.bucket_ms
            self.handle.registerTimer(timer)
        self._hold(new)
        self.last.update((latest, timer, busy))
        self.handle.registerTimer(latest + self.idle_ms)
        yield self._row(key, self._folded(new, self.open.iterator() if busy else ()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        latest, timer, busy = self.last.get() or (0, 0, False)
        passed = lambda bucket: (bucket + 1) * self.bucket_ms <= now
        if timer and timer <= now:
            new = self._held()
            keys = [tuple(k) for k in self.open.keys()] if busy else []
            done, old = [k for k in keys if passed(k[0])], {k: a for k, a in new.items() if passed(k[0])}
            self.sealed.update(self._folded(old, ((k, self.open.getValue(k)) for k in done)))
            for k in done:
                self.open.removeKey(k)
            if old:
                self._hold({k: a for k, a in new.items() if k not in old})
            left = [b for b, _ in (*new, *keys) if not passed(b)]
            timer = (min(left) + 1) * self.bucket_ms if left else 0
            if timer:
                self.handle.registerTimer(timer)
            self.last.update((latest, timer, len(keys) > len(done)))
        if latest + self.idle_ms <= now:
            for state in (self.sealed, self.few, self.open, self.last):
                state.clear()
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in OUTPUT.split(", ")})

    def close(self) -> None:
        pass


def request_totals(stream: DataFrame, late: str = "10 minutes", bucket_ms: int = 3_600_000, idle_ms: int = 1 << 46) -> DataFrame:
    """stream: user_id, event_id, ts, action. Of each request that a batch touches its counts so far (OUTPUT).

    Needs the RocksDB state store, which `with_rocks` sets for the session.
    """
    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Requests(bucket_ms, idle_ms), OUTPUT, "update", "eventTime")


def with_rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
