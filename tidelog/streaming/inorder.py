"""Keyed streams in the order of their time stamps, whatever batches rows come in.

Rows wait in slots of time. When the watermark has passed a slot, no row of it can come any more; a timer then
hands out its rows in the order of (ts, seq). Late rows and borders of batches therefore change nothing.

Keys are dealt into buckets by their hash. State and timers belong to a bucket, whose waiting rows and whose keys lie
in the store as whole columns, so the calls to it grow with buckets, slots and batches, not with keys. A task holds one
slot of one bucket at a time beside what is kept of the bucket's keys, and a batch adds to a slot without reading what
waits there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Of a stream's whole life: its checkpoint holds the state of as many.
BUCKETS = 256


def packed(columns: Mapping[str, pa.Array | np.ndarray]) -> bytes:
    """Columns as an Arrow stream."""
    batch = pa.record_batch([pa.array(c) for c in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Kept:
    """What is kept of the keys of a bucket: a column per value, a place per key."""

    def __init__(self, fresh: Mapping[str, int | bool], data: bytes | None):
        self.fresh, self.keys = fresh, []
        self.columns = {n: np.empty(0, np.asarray(v).dtype) for n, v in fresh.items()}
        if data is not None:
            table = unpacked(data)
            self.keys = table["key"].to_pylist()
            self.columns = {n: table[n].to_numpy().copy() for n in fresh}
        self.place = {k: i for i, k in enumerate(self.keys)}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def places(self, keys: pa.ChunkedArray) -> np.ndarray:
        """Places of the keys of rows; new keys get fresh values."""
        coded = keys.combine_chunks().dictionary_encode("encode")
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        at = np.empty(len(coded.dictionary), "int64")
        for i, key in enumerate(coded.dictionary.to_pylist()):
            at[i] = place = self.place.setdefault(key, len(self.keys))
            if place == len(self.keys):
                self.keys.append(key)
        more = len(self.keys) - len(next(iter(self.columns.values())))
        if more:
            self.columns = {n: np.append(c, np.full(more, self.fresh[n], c.dtype)) for n, c in self.columns.items()}
        return at[coded.indices.to_numpy()]

    def names(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), object)
        out[:] = [self.keys[i] for i in places.tolist()]
        return out

    def data(self, live: np.ndarray) -> bytes | None:
        """The keys of which something is known."""
        if not live.any():
            return None
        keys = pa.array([self.keys[i] for i in np.flatnonzero(live).tolist()], pa.string())
        return packed({"key": keys, **{n: c[live] for n, c in self.columns.items()}})


class InOrder(StatefulProcessor):
    """Subclasses say what is kept of a key (``FRESH``: names and the values of a new key), what to do with the rows of a
    slot (``release``), what when time goes on (``idle``) and of which keys something is left to keep (``live``).

    Rows have key (a place in ``kept``), ts, seq (bigint) and flag (boolean); ``release`` gets them as arrays in the order of
    (key, ts, seq), ts in microseconds, and where the rows of a key start.
    """

    FRESH: Mapping[str, int | bool] = {}

    def __init__(self, slot_seconds: int):
        self.width = slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getValueState("parts", "slot array<bigint>, n array<int>")
        self.rows = handle.getMapState("rows", "slot bigint, part int", "columns binary")
        self.kept = handle.getValueState("kept", "columns binary")
        self.passed = set()

    def release(self, kept: Kept, key: np.ndarray, ts: np.ndarray, seq: np.ndarray, flag: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def idle(self, kept: Kept, until: int) -> Iterator[pd.DataFrame]:
        """Called when all rows before ``until``, the end of a slot, are released."""
        return iter(())

    def live(self, kept: Kept) -> np.ndarray:
        raise NotImplementedError

    def wakes(self, kept: Kept) -> np.ndarray:
        """Times of keys that want a call of ``idle`` at the end of the slot that holds them."""
        return np.empty(0, "int64")

    def _timer(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.width // 1000)

    def _waiting(self) -> dict[int, int]:
        """Slots with rows and the number of their parts."""
        return dict(zip(*self.parts.get(), strict=True)) if self.parts.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        first = min(waiting, default=None)
        for batch in rows:
            ts = batch["ts"].to_numpy("datetime64[us]").astype("int64")
            slots = ts // self.width
            order = np.argsort(slots, kind="stable")
            names = pa.array(batch["key"], pa.string(), from_pandas=True).take(pa.array(order))
            columns = {"ts": ts[order], "seq": batch["seq"].to_numpy("int64")[order], "flag": batch["flag"].to_numpy(bool)[order]}
            found, starts = np.unique(slots[order], return_index=True)
            for slot, lo, hi in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ts)], strict=True):
                n = waiting.get(slot, 0)
                part = {"key": names.slice(lo, hi - lo), **{c: v[lo:hi] for c, v in columns.items()}}
                self.rows.updateValue((slot, n), (packed(part),))
                waiting[slot] = n + 1
        # One timer for the first slot is enough: what has fired sets the next.
        if first is None or min(waiting) < first:
            self._timer(min(waiting))
        self.parts.update((list(waiting), list(waiting.values())))
        return iter(())

    def _taken(self, slot: int, n: int) -> pa.Table:
        """The rows that wait in a slot, no more in the store."""
        parts = [unpacked(self.rows.getValue((slot, i))[0]) for i in range(n)]
        for i in range(n):
            self.rows.removeKey((slot, i))
        return pa.concat_tables(parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A batch's first timer of a bucket does all that the watermark has passed.
        if key in self.passed:
            return
        self.passed.add(key)
        self.watermark = timerValues.getCurrentWatermarkInMs()
        until = self.watermark * 1000 // self.width
        waiting = self._waiting()
        due = sorted(slot for slot in waiting if slot < until)
        kept = Kept(self.FRESH, self.kept.get()[0] if self.kept.exists() else None)
        for slot in due:
            yield from self.idle(kept, slot * self.width)
            rows = self._taken(slot, waiting.pop(slot))
            at, ts, seq, flag = (kept.places(rows["key"]), *(rows[c].to_numpy() for c in ("ts", "seq", "flag")))
            order = np.lexsort((seq, ts, at))
            at = at[order]
            yield from self.release(kept, at, ts[order], seq[order], flag[order], np.flatnonzero(np.diff(at, prepend=-1)))
        yield from self.idle(kept, until * self.width)
        if due:
            self.parts.update((list(waiting), list(waiting.values()))) if waiting else self.parts.clear()
        data = kept.data(self.live(kept))
        self.kept.update((data,)) if data is not None else self.kept.clear()
        coming = [*waiting, *(self.wakes(kept) // self.width).tolist()]
        if coming:
            self._timer(min(coming))


def in_order(rows: DataFrame, key: str, processor: InOrder, output: str, late: str, buckets: int = BUCKETS) -> DataFrame:
    """Run a processor over a stream of (key, ts, seq, flag). Rows without a time are left out; rows more than ``late``
    behind the newest one may be. Keys are strings; ``buckets`` stays as it is for the life of a checkpoint."""
    name = F.col(key).cast("string")
    stamped = rows.select(
        F.pmod(F.hash(name), F.lit(buckets)).alias("bucket"), name.alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce("flag", F.lit(False)).alias("flag"),
    )
    waiting = stamped.where("ts IS NOT NULL").withWatermark("ts", late)
    return waiting.groupBy("bucket").transformWithStateInPandas(processor, output, "append", "eventTime")
