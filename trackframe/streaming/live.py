"""Tracks from a stream of detections: the rules of `tracking.track`, with the live tracks of each match as state.

Detections wait until the watermark has passed their frame; then frames are taken in order. Later ones are dropped.
Ticks and ids are counted in that order: both are shared by the types of a match, so a match is one key. A match that
has had no frame for `idle_s` of event time is over: a timer clears its state. Should it go on after that, it is a new
match with ids from 1.

Input: match_id, frame_idx, slot, event_time (timestamp), object_type, x1, y1, x2, y2, confidence.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackframe.operators import tracking as T
from trackframe.sources import io

OUT = "match_id long, track_id long, frame_idx long, object_type string, x1 double, y1 double, x2 double, y2 double, confidence double, age long, hits long, time_since_update long"
NAMES = [c.split()[0] for c in OUT.split(", ")]


#: Milliseconds of a match whose waiting detections are kept together, rows held before they go to the state, and rows of tracks put out at once.
BUCKET_MS, HELD, BATCH = 1000, 100_000, 20_000


class LiveTracks(StatefulProcessor):
    """State of a match: ticks, ids given, end and tracks by type, and the detections that wait, as chunks of columns by bucket of time.

    A timer stands for the first frame that waits, not one for each: when it expires, all frames that the watermark has
    passed are taken in one go, with one reading and one writing of the live tracks.
    """

    def __init__(self, thresh: float = 0.5, buffer: int = 30, min_iou: float = 0.3, min_hits: int = 3, idle_s: float = 600.0):
        self.rules = (thresh, buffer, min_iou, min_hits)
        self.idle_ms = int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "state binary")
        self.waiting = handle.getMapState("waiting", "bucket long, chunk long", "found binary")

    def _wait(self, held: list) -> int:
        """Adds rows to what waits, a chunk to a bucket; no chunk is read or written again until it is taken. Returns the first time."""
        import numpy as np
        import pandas as pd

        pdf = pd.concat(held, ignore_index=True)
        cols = [pdf[c].astype("int64").to_numpy() for c in ("ms", "frame_idx", "slot")] + [pdf["object_type"].to_numpy(), *[pdf[c].astype("float64").to_numpy() for c in ("x1", "y1", "x2", "y2", "confidence")]]
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        buckets = cols[0] // BUCKET_MS
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            self.waiting.updateValue((int(buckets[i]), time.time_ns()), (pickle.dumps([c[i:j] for c in cols]),))
        return int(cols[0][0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        held, first = [], []
        for pdf in rows:
            if len(pdf):
                held.append(pdf)
            if sum(map(len, held)) >= HELD:
                first.append(self._wait(held))
                held = []
        if held:
            first.append(self._wait(held))
        if first:
            self.handle.registerTimer(min(first) + 1)
        yield pd.DataFrame(columns=NAMES)

    def _ready(self, watermark: int) -> Iterator:
        """(ms, its rows) in order of time, of all that the watermark has passed; a bucket of which only a part is ready leaves the rest."""
        import numpy as np

        chunks: dict[int, list] = {}
        for bucket, chunk in self.waiting.keys():
            if bucket * BUCKET_MS < watermark:
                chunks.setdefault(bucket, []).append(chunk)
        for bucket in sorted(chunks):
            parts = [pickle.loads(bytes(self.waiting.getValue((bucket, c))[0])) for c in sorted(chunks[bucket])]  # noqa: S301
            for c in chunks[bucket]:
                self.waiting.removeKey((bucket, c))
            cols = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts, strict=True)]
            # In a frame by slot; of one slot as they came.
            order = np.lexsort((cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            now = int(np.searchsorted(cols[0], watermark))
            if now < len(order):
                self.waiting.updateValue((bucket, min(chunks[bucket])), (pickle.dumps([c[now:] for c in cols]),))
            yield from groupby(zip(*(c[:now].tolist() for c in cols), strict=True), key=lambda r: r[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        watermark = timerValues.getCurrentWatermarkInMs()
        tick, last_id, end, tracks = pickle.loads(bytes(self.live.get()[0])) if self.live.exists() else (0, 0, None, {})  # noqa: S301
        out, before = [], end
        for ms, ready in self._ready(watermark):
            if end is not None and ms > end:
                # Over before this frame, though the watermark has passed both at once.
                tick, last_id, tracks = 0, 0, {}
            for frame, rows in groupby(ready, key=lambda r: r[1]):
                tick += 1
                last_id = T.next_frame(tracks, tick, last_id, [(r[2], r[3], r[4:8], r[8]) for r in rows], self.rules)
                out += [(key[0], t.number, frame, kind, *t.box, t.confidence, t.age, t.hits, t.missed) for kind in sorted(tracks, key=str) for t in tracks[kind] if t.confirmed]
            end = ms + self.idle_ms
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        if end is not None and end != before:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            if end >= watermark:
                self.handle.registerTimer(end + 1)
                self.live.update((pickle.dumps((tick, last_id, end, tracks)),))
        if end is not None and end < watermark:
            # What still waits is after the end.
            self.live.clear()
        left = min((bucket for bucket, _ in self.waiting.keys()), default=None)
        if left is not None:
            self.handle.registerTimer(max(left * BUCKET_MS, watermark) + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, delay: str = "1 second", **rules: float) -> DataFrame:
    # Milliseconds as the watermark counts them, whatever the session's time zone.
    return detections.withWatermark("event_time", delay).withColumn("ms", F.unix_millis("event_time")).groupBy("match_id").transformWithStateInPandas(
        LiveTracks(**rules), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A match that no table has; its one row, far ahead, lets the watermark pass all others.
LAST = -(1 << 62)


def replay(detections: DataFrame, **rules: float) -> DataFrame:
    """A finished table (with ts_s) through the live tracker: a stream over a written copy, run until all of it is used. Returns what it has written."""
    spark, at = detections.sparkSession, io.scratch(detections.sparkSession, "replay")
    cols = ["match_id", "frame_idx", "slot", "object_type", "x1", "y1", "x2", "y2", "confidence"]
    # A day on: rows at the epoch would be late from the start.
    rows = detections.select(*cols, F.timestamp_millis(F.round(F.col("ts_s") * 1000).cast("long") + 86_400_000).alias("event_time"))
    rows.write.parquet(f"{at}/in")
    # What has been written tells its end; the rows are not made again for it.
    last = spark.read.schema(rows.schema).parquet(f"{at}/in").agg(F.max("event_time").alias("event_time"))
    end = last.select(*[F.lit({"match_id": LAST, "object_type": "none"}.get(c, 0)).cast(dict(rows.dtypes)[c]).alias(c) for c in cols], F.coalesce("event_time", F.timestamp_millis(F.lit(0))) + F.expr("INTERVAL 1 DAY"))
    end.toDF(*rows.columns).write.mode("append").parquet(f"{at}/in")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        found = track_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), **rules).filter(F.col("match_id") != LAST)
        found.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUT).parquet(f"{at}/out")
