"""Keyed state with event-time expiry.

State is one small row per key; timers fire on the watermark, so a replayed stream
gives the same rows.  RocksDB keeps the state off the heap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracks import ASSOC_M, LOST_FRAMES, MERGE_M, TRACK, TrackState, merge_frame

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Latest(StatefulProcessor):
    """A change row for every row of a key, in event order, and one when the key has been unseen for more than ``ttl`` seconds.

    An ``off`` row ends a key at once (of equal times it comes last).  A key that comes back appears again, so the
    output is the same however the rows are dealt to micro-batches.  Rows older than the newest of their key are stale.
    """

    def __init__(self, key: list[str], cols: list[str], types: dict[str, str], ttl: float, words: tuple[str, str, str]):
        self.key, self.cols, self.types, self.ttl_ms, self.words = key, cols, types, int(ttl * 1000), words

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"v{i} {self.types[c]}" for i, c in enumerate(self.cols))
        self.handle = handle
        self.state = handle.getValueState("latest", f"_ms bigint{', ' + fields if fields else ''}")

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.key, "event_ms", *self.cols, "change"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        appear, stay, leave = self.words
        last = tuple(self.state.get()) if self.state.exists() else None
        batch = pd.concat([b[["event_ms", *(["off"] if "off" in b else []), *self.cols]] for b in rows], ignore_index=True)
        if "off" not in batch:
            batch["off"] = False
        out: list[tuple] = []
        for ms, off, *values in batch.sort_values(["event_ms", "off"], kind="stable")[["event_ms", "off", *self.cols]].itertuples(index=False):
            if last is not None and ms < last[0]:
                continue
            if last is not None and ms - last[0] > self.ttl_ms:
                out.append((last[0] + self.ttl_ms, *last[1:], leave))
                last = None
            if off:
                if last is not None:
                    out.append((int(ms), *last[1:], leave))
                last = None
                continue
            out.append((int(ms), *values, appear if last is None else stay))
            last = (int(ms), *values)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if last is None:
            self.state.clear()
        else:
            self.state.update(last)
            self.handle.registerTimer(last[0] + self.ttl_ms + 1)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last = tuple(self.state.get())
            self.state.clear()
            yield self._frame(key, [(last[0] + self.ttl_ms, *last[1:], self.words[2])])

    def close(self) -> None:
        pass


def _keyed_latest(stream: DataFrame, key: Sequence[str], ttl: float, ts: str, late: str, words=("live", "live", "retired")) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    key = list(key)
    types = dict(stream.dtypes)
    cols = [c for c in stream.columns if c not in (*key, ts, "off")]
    marked = stream.withWatermark(ts, late).withColumn("event_ms", F.unix_millis(ts))
    fields = [*key, "event_ms", *cols, "change"]
    types = types | {"event_ms": "bigint", "change": "string"}
    schema = ", ".join(f"`{c}` {types[c]}" for c in fields)
    return marked.groupBy(*key).transformWithStateInPandas(
        _Latest(key, cols, types, ttl, words), schema, "Append", "EventTime"
    )


def latest_by_key(stream: DataFrame, key: str, retire: float = 20.0, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Rows of each key as ``live``; after more than ``retire`` seconds unseen, one ``retired`` row."""
    return _keyed_latest(stream, [key], retire, ts, late)


def retire_after(poll_seconds: float) -> float:
    """Seconds unseen before a vehicle retires: three polls, twenty seconds at least."""
    return max(20.0, 3 * poll_seconds)


def detections_latest(stream: DataFrame, ttl: float = 6.0, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Detections per camera, stale after more than ``ttl`` seconds."""
    return _keyed_latest(stream, ["camera"], ttl, ts, late, ("live", "live", "stale"))


def active_keys(stream: DataFrame, key: str = "camera", ttl: float = 12.0, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Heartbeat set: active until ``ttl`` seconds without a beat, or a row with ``off`` true."""
    return _keyed_latest(stream, [key], ttl, ts, late, ("active", "active", "inactive"))


def entity_ttl(stream: DataFrame, key: str, ttl: float = 5.0, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Pose-driven entities, expired after ``ttl`` seconds without an update."""
    return _keyed_latest(stream, [key], ttl, ts, late, ("live", "live", "expired"))


def snapshot_stream_diff(stream: DataFrame, key: str, every: float, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Entities that appear, stay or leave in a feed of snapshots taken ``every`` seconds.

    An entity that the snapshot after its last one lacks leaves at that snapshot's time, and may appear again.
    """
    return _keyed_latest(stream, [key], every, ts, late, ("appear", "stay", "leave"))


#: Rows that a tracker gathers before it hands them on.
_OUT_ROWS = 20_000


class _Tracker(StatefulProcessor):
    """Cross-view merge and association per camera, frame by frame.

    The rows of a camera in a micro-batch are held as plain columns, for frames come in any order; results are handed on
    as they come.
    """

    def __init__(self, merge: float, assoc: float, lost: int):
        self.merge, self.assoc, self.lost = merge, assoc, lost

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "x double, z double, ax double, az double, heading double, frame bigint, kind int, quad int"
        self.tracks = handle.getMapState("tracks", "tid int", fields)
        self.next = handle.getValueState("next", "tid int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((k[0], *v) for k, v in self.tracks.iterator())
        state = TrackState(np.array(held, TRACK), self.next.get()[0] if self.next.exists() else 1)
        names = ["camera", "frame", "track_id", "x", "z", "heading", "cls", "quad", "quads"]
        parts: dict[str, list] = {c: [] for c in ("frame", "det_id", "x", "z", "quad", "cls")}
        for batch in rows:
            batch = batch[batch["frame"].notna()]
            for c, held_c in parts.items():
                held_c.append(batch[c].to_numpy(copy=True))
        col = {c: np.concatenate(parts.pop(c)) for c in list(parts)}
        order = np.lexsort((col.pop("det_id"), col["frame"]))
        frames = col.pop("frame")[order]
        cuts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(frames) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(frames)]):
            frame = int(frames[a])
            clusters = merge_frame(*[col[c][order[a:b]].tolist() for c in ("x", "z", "quad", "cls")], merge=self.merge)
            out += [(key[0], frame, *r) for r in state.update(frame, clusters, self.assoc, self.lost)]
            if len(out) >= _OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        left = state.tracks.tolist()
        for gone in {k[0] for k in self.tracks.keys()} - {t[0] for t in left}:
            self.tracks.removeKey((gone,))
        for tid, *values in left:
            self.tracks.updateValue((tid,), tuple(values))
        self.next.update((state.next_id,))
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def track_stream(stream: DataFrame, merge: float = MERGE_M, assoc: float = ASSOC_M, lost: int = LOST_FRAMES) -> DataFrame:
    """Live form of ``associate_tracks``; frames must not be split between micro-batches."""
    use_rocksdb(stream.sparkSession)
    types = dict(stream.dtypes)
    rows = stream.select("camera", "frame", "det_id", "x", "z", F.col("quad").cast("int").alias("quad"), F.col("cls").cast("int").alias("cls"))
    schema = (
        f"camera {types['camera']}, frame bigint, track_id int, x double, z double, heading double, cls int, quad int, quads int"
    )
    return rows.groupBy("camera").transformWithStateInPandas(_Tracker(merge, assoc, lost), schema, "Append", "None")


class _Closed(StatefulProcessor):
    """Rows of a key and window, held until the watermark passes the window's end."""

    def __init__(self, cols: list[str], types: dict[str, str]):
        self.cols, self.types = cols, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ", ".join(f"v{i} {self.types[c]}" for i, c in enumerate(self.cols)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.rows.appendList([tuple(r) for r in batch[self.cols].astype(object).itertuples(index=False)])
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int(key[-1]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=self.cols)
        self.rows.clear()
        yield held.assign(_end=int(key[-1]))

    def close(self) -> None:
        pass


def closed_windows(stream: DataFrame, seconds: int, ts: str = "ts", key: str = "camera", late: str = "0 seconds") -> DataFrame:
    """The rows of a stream, each once its tumbling window is over; all rows of a key and window come in one micro-batch.

    ``_end`` is the window's end in milliseconds.  State holds the rows of open windows only.
    """
    use_rocksdb(stream.sparkSession)
    cols = [c for c in stream.columns if c != ts] + [f"{ts}_ms"]
    timed = stream.withWatermark(ts, late).withColumn(f"{ts}_ms", F.unix_millis(ts))
    types = dict(timed.dtypes)
    end = F.unix_millis(F.window(ts, f"{seconds} seconds")["end"])
    keyed = timed.withColumn("_end", end)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", _end bigint"
    return keyed.groupBy(key, "_end").transformWithStateInPandas(_Closed(cols, types), schema, "Append", "EventTime")


class _Settle(StatefulProcessor):
    """Last samples of a cell; a value is committed when they agree and it moved enough."""

    def __init__(self, key: list[str], window: int, max_range: float, min_change: float, kept: int):
        self.key, self.window, self.max_range, self.min_change, self.kept = key, window, max_range, min_change, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cell", "samples array<double>, committed double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        samples, committed = (list(held[0]), held[1]) if held is not None else ([], None)
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("seq").itertuples(index=False):
            samples = [*samples, float(r.value)][-self.kept :]
            recent = sorted(samples[-self.window :])
            if len(recent) < min(4, self.window) or recent[-1] - recent[0] > self.max_range:
                continue
            mid = recent[len(recent) // 2]
            if committed is None or abs(mid - committed) > self.min_change:
                committed = mid
                out.append((*key, int(r.seq), mid))
        self.state.update((samples, committed))
        yield pd.DataFrame(out, columns=[*self.key, "seq", "value"])

    def close(self) -> None:
        pass


def settled_grid(stream: DataFrame, key: Sequence[str] = ("ix", "iz"), window: int = 5, max_range: float = 1.0, min_change: float = 0.25, kept: int = 8) -> DataFrame:
    """Commits per cell of samples (key, seq, value): key, seq, value."""
    use_rocksdb(stream.sparkSession)
    key = list(key)
    types = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", seq bigint, value double"
    rows = stream.select(*key, F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(*key).transformWithStateInPandas(_Settle(key, window, max_range, min_change, kept), schema, "Append", "None")
