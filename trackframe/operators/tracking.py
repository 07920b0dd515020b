"""Tracks from detections.

Frames follow each other, so this is one keyed job per match: types never match each other, but they share the number of
frames and that of births, which both are counted as the match's rows pass in order. A track's motion is four independent
filters with constant velocity, for centre, area and aspect.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import slices
from trackframe.sources import io

#: Fixed noise: of positions, of velocities, and of that of the aspect; first variances.
Q_POS, Q_VEL, Q_VEL_ASPECT, P_POS, P_VEL = 1.0, 0.01, 0.0001, 10.0, 10_000.0
SCHEMA = (
    "match_id long, object_type string, frame_idx long, ts_s double, x1 double, y1 double, x2 double, y2 double, "
    "confidence double, age long, hits long, time_since_update long, track_id long"
)
#: Rows of tracks in a batch that leaves a task.
BATCH = 20_000


class Track:
    """State of one track; `step` predicts, `take` takes a detection. Variances follow from the noise and from when there were
    detections alone, so centre and area, whose noise is the same, share theirs (p); the aspect has its own (q)."""

    __slots__ = ("x", "v", "pxx", "pxv", "pvv", "qxx", "qxv", "qvv", "box", "confidence", "age", "hits", "missed", "confirmed", "born", "number")

    def __init__(self, box: tuple, confidence: float, born: tuple):
        self.x, self.v = _state(box), [0.0] * 4
        self.pxx = self.qxx = P_POS
        self.pxv = self.qxv = 0.0
        self.pvv = self.qvv = P_VEL
        self.box, self.confidence, self.born = box, confidence, born
        self.age, self.hits, self.missed, self.confirmed, self.number = 0, 1, 0, False, None

    def step(self) -> None:
        self.x = [a + b for a, b in zip(self.x, self.v, strict=True)]
        self.pxx += 2 * self.pxv + self.pvv + Q_POS
        self.pxv += self.pvv
        self.pvv += Q_VEL
        self.qxx += 2 * self.qxv + self.qvv + Q_POS
        self.qxv += self.qvv
        self.qvv += Q_VEL_ASPECT
        self.box = _box(self.x)
        self.age += 1
        self.missed += 1

    def take(self, box: tuple, confidence: float, min_hits: int) -> None:
        s, r = self.pxx + 1.0, self.qxx + 1.0
        kx, kv, lx, lv = self.pxx / s, self.pxv / s, self.qxx / r, self.qxv / r
        y = [a - b for a, b in zip(_state(box), self.x, strict=True)]
        (a, b, c, d), (e, f, g, h) = self.x, self.v
        self.x = [a + kx * y[0], b + kx * y[1], c + kx * y[2], d + lx * y[3]]
        self.v = [e + kv * y[0], f + kv * y[1], g + kv * y[2], h + lv * y[3]]
        self.pvv -= kv * self.pxv
        self.pxv -= kx * self.pxv
        self.pxx -= kx * self.pxx
        self.qvv -= lv * self.qxv
        self.qxv -= lx * self.qxv
        self.qxx -= lx * self.qxx
        self.box, self.confidence, self.missed = box, confidence, 0
        self.hits += 1
        self.confirmed = self.confirmed or self.hits >= min_hits


def _state(b: tuple) -> list[float]:
    w, h = b[2] - b[0], b[3] - b[1]
    return [b[0] + w / 2, b[1] + h / 2, w * h, w / h if h > 0 else 1.0]


def _box(x: list[float]) -> tuple:
    area, aspect = max(x[2], 0.0), max(x[3], 0.1)
    h = math.sqrt(area / aspect)
    w = aspect * h
    return (x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2)


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _near(box: tuple, found: list, min_iou: float) -> list[int]:
    """Places of the detections that can overlap: those beside the box are told by two comparisons."""
    if not min_iou > 0:
        return list(range(len(found)))
    left, right = box[0], box[2]
    return [j for j, d in enumerate(found) if not (d[1][0] >= right or d[1][2] <= left)]


def _match(tracks: list[Track], found: list, min_iou: float, min_hits: int) -> tuple[list[Track], list]:
    """Greedy one-to-one matching by overlap; returns what is left of both."""
    pairs = sorted((-v, i, j) for i, t in enumerate(tracks) for j in _near(t.box, found, min_iou) if (v := _iou(t.box, found[j][1])) >= min_iou)
    used_t, used_d = set(), set()
    for _, i, j in pairs:
        if i not in used_t and j not in used_d:
            used_t.add(i)
            used_d.add(j)
            tracks[i].take(found[j][1], found[j][2], min_hits)
    return [t for i, t in enumerate(tracks) if i not in used_t], [d for j, d in enumerate(found) if j not in used_d]


def advance(tracks: list[Track], tick: int, found: list, thresh: float, buffer: int, min_iou: float, min_hits: int) -> list[Track]:
    """One frame with detections `found` (slot, box, confidence): predict, match in three rounds, start and drop tracks."""
    for t in tracks:
        t.step()
    high, low = [d for d in found if d[2] >= thresh], [d for d in found if d[2] < thresh]
    confirmed, tentative = [t for t in tracks if t.confirmed], [t for t in tracks if not t.confirmed]
    left, high = _match(confirmed, high, min_iou, min_hits)
    _match(left, low, min_iou, min_hits)
    _, high = _match(tentative, high, min_iou, min_hits)
    tracks = tracks + [Track(box, c, (tick, slot)) for slot, box, c in high]
    return [t for t in tracks if t.missed < buffer]


def ticked(detections: DataFrame) -> DataFrame:
    """detections with `tick`, the number of the frame among the match's frames that have any."""
    return slices.dense_rank(detections, ["match_id"], ["frame_idx"], "tick")


def next_frame(tracks: dict[str | None, list[Track]], tick: int, last_id: int, here: list, rules: tuple) -> int:
    """Takes the tracks of all types of a match to their next frame, with detections `here` (slot, type, box, confidence) in order of slots.

    A type also ages where only others were seen. Births of a frame are counted by slot, whatever their type; returns the last number given.
    """
    found: dict = {kind: [] for kind in tracks}
    for slot, kind, box, confidence in here:
        own = found.setdefault(kind, [])
        if confidence is not None and confidence == confidence:
            own.append((slot, box, confidence))
    born = []
    for kind in sorted(found, key=str):
        tracks[kind] = advance(tracks.get(kind, []), tick, found[kind], *rules)
        born += [t for t in tracks[kind] if t.number is None]
    for t in sorted(born, key=lambda t: t.born):
        last_id += 1
        t.number = last_id
    return last_id


def _values(column) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _tracker(*rules: float):
    """Rows of whole matches in order of frames and slots in, rows of confirmed tracks out, batch by batch: the live tracks and one frame are all that is kept."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        match, frame, ts, tick, last_id, tracks, here, out, open_ = None, None, None, 0, 0, {}, [], [], False

        def close() -> None:
            nonlocal tick, last_id
            tick += 1
            last_id = next_frame(tracks, tick, last_id, here, rules)
            out.extend((match, kind, frame, ts, *t.box, t.confidence, t.age, t.hits, t.missed, t.number) for kind, own in tracks.items() for t in own if t.confirmed)

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return done

        for b in batches:
            for m, idx, slot, kind, s, x1, y1, x2, y2, confidence in zip(*(_values(c) for c in b.columns), strict=True):
                if not open_ or idx != frame or m != match:
                    if open_:
                        close()
                        if len(out) >= BATCH:
                            yield batch()
                    if m != match:
                        tick, last_id, tracks = 0, 0, {}
                    match, frame, ts, here, open_ = m, idx, s, [], True
                # A frame's time is the least of its rows'.
                elif s is not None and (ts is None or ts != ts or s < ts):
                    ts = s
                if slot is not None:
                    here.append((slot, kind, (x1, y1, x2, y2), confidence))
        if open_:
            close()
        if out:
            yield batch()

    return run


def _of_kinds(rows: DataFrame, kinds: tuple[str, ...], parts: int) -> DataFrame:
    """Rows of these types, by match; all others of a frame become one row, which has their least time and no slot."""
    values = ["slot", "x1", "y1", "x2", "y2", "confidence"]
    own = F.coalesce(F.col("object_type").isin(*kinds), F.lit(False))
    dealt = rows.withColumns({c: F.when(own, F.col(c)) for c in ("object_type", *values)}).repartition(parts, "match_id")
    # Rows of these types are told apart by a number, so that none is lost; the others have none and fall together.
    told = dealt.withColumn("own", F.when(F.col("object_type").isNotNull(), F.monotonically_increasing_id()))
    return told.groupBy("match_id", "frame_idx", "object_type", "own").agg(F.min("ts_s").alias("ts_s"), *[F.first(c).alias(c) for c in values]).select(*rows.columns)


def track(detections: DataFrame, thresh: float = 0.5, buffer: int = 30, min_iou: float = 0.3, min_hits: int = 3, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Confirmed tracks on every frame of their match while they live, also where only predicted. track_id counts a match's births from 1, also those never confirmed.

    kinds: only tracks of these types are wanted. Types never match each other, so the tracks are the same without the others'
    boxes; their frames and times still count. Births are then counted among these types, in the same order.
    """
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = detections.filter("match_id IS NOT NULL").select("match_id", "frame_idx", F.col("slot").cast("long").alias("slot"), "object_type", "ts_s", "x1", "y1", "x2", "y2", "confidence")
    # With their number given, partitions stay as many: tracking takes longer than their bytes tell.
    dealt = rows.repartition(parts, "match_id") if kinds is None else _of_kinds(rows, kinds, parts)
    ordered = dealt.sortWithinPartitions("match_id", "frame_idx", "slot")
    # Written, so that readers of several columns or times find the tracks and do not run Python again.
    return io.saved(ordered.mapInArrow(_tracker(thresh, buffer, min_iou, min_hits), SCHEMA), "tracks")
