"""Sequential and iterative operators against plain Python."""

import collections
import itertools
import random
from datetime import UTC, datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackframe.operators import clusters, teams, tracking
from trackframe.plans import queries
from trackframe.sources import io, runs
from trackframe.streaming import live

DETECTION = "match_id long, frame_idx long, ts_s double, slot long, object_type string, x1 double, y1 double, x2 double, y2 double, confidence double"


def detections(seed=1, frames=90):
    """Players that drift and cross, with gaps, weak and missing detections, and a ball that is seen rarely."""
    r, rows = random.Random(seed), []
    for match in (1, 2):
        who = [(r.uniform(0, 800), r.uniform(0, 500), r.uniform(-6, 6), r.uniform(-4, 4)) for _ in range(7)]
        for f in range(frames):
            if f % 17 == 5:
                continue
            for slot, (x, y, vx, vy) in enumerate(who):
                if r.random() < (0.7 if slot == 0 else 0.15):
                    continue
                w, h = (16, 16) if slot == 0 else (40, 90)
                cx, cy = x + vx * f + r.gauss(0, 1.5), y + vy * f + r.gauss(0, 1.5)
                rows.append((match, f, f / 25, slot, "ball" if slot == 0 else "player", cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, r.choice([0.3, 0.45, 0.6, 0.9])))
    return rows


class Filter:
    """Eight-dimensional constant-velocity filter with full matrices."""

    def __init__(self, box, confidence, born):
        self.f = np.eye(8) + np.eye(8, k=4)
        self.q = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.01, 0.0001])
        self.p = np.diag([10.0] * 4 + [10_000.0] * 4)
        self.x = np.concatenate([self.measured(box), np.zeros(4)])
        self.box, self.confidence, self.born, self.age, self.hits, self.missed, self.confirmed = box, confidence, born, 0, 1, 0, False

    @staticmethod
    def measured(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return np.array([b[0] + w / 2, b[1] + h / 2, w * h, w / h])

    def step(self):
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
        area, aspect = max(self.x[2], 0), max(self.x[3], 0.1)
        h = (area / aspect) ** 0.5
        w = aspect * h
        self.box = (self.x[0] - w / 2, self.x[1] - h / 2, self.x[0] + w / 2, self.x[1] + h / 2)
        self.age, self.missed = self.age + 1, self.missed + 1

    def take(self, box, confidence):
        m = np.eye(4, 8)
        gain = self.p @ m.T @ np.linalg.inv(m @ self.p @ m.T + np.eye(4))
        self.x = self.x + gain @ (self.measured(box) - m @ self.x)
        self.p = (np.eye(8) - gain @ m) @ self.p
        self.box, self.confidence, self.missed, self.hits = box, confidence, 0, self.hits + 1
        self.confirmed |= self.hits >= 3


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def greedy(tracks, found):
    taken = set()
    while True:
        pairs = [(overlap(t.box, d[5:9]), t, d) for t in tracks if t not in taken for d in found if d not in taken]
        best = max((v for v, _, _ in pairs), default=0)
        if best < 0.3:
            return [t for t in tracks if t not in taken], [d for d in found if d not in taken]
        t, d = next((t, d) for v, t, d in pairs if v == best)
        taken |= {t, d}
        t.take(d[5:9], d[9])


def plain_tracks(rows):
    out, born = {}, set()
    for match in {r[0] for r in rows}:
        frames, tracks, tick = sorted({r[1] for r in rows if r[0] == match}), collections.defaultdict(list), 0
        for f in frames:
            tick += 1
            for kind in sorted({r[4] for r in rows if r[0] == match}):
                here = sorted(r for r in rows if r[:2] == (match, f) and r[4] == kind)
                for t in tracks[kind]:
                    t.step()
                sure, new = [t for t in tracks[kind] if t.confirmed], [t for t in tracks[kind] if not t.confirmed]
                left, high = greedy(sure, [d for d in here if d[9] >= 0.5])
                greedy(left, [d for d in here if d[9] < 0.5])
                _, high = greedy(new, high)
                born.update((match, tick, d[3]) for d in high)
                tracks[kind] = [t for t in tracks[kind] + [Filter(d[5:9], d[9], (tick, d[3])) for d in high] if t.missed < 30]
                for t in tracks[kind]:
                    if t.confirmed:
                        out[match, kind, f, t.born] = (t.box, t.confidence, t.age, t.hits, t.missed)
    return out, born


def numbered(found, born):
    """Tracks counted from 1 by their birth, per match; those that are never confirmed count, too."""
    number = {b: i for m in {b[0] for b in born} for i, b in enumerate(sorted(b for b in born if b[0] == m), 1)}
    return {(m, kind, f, number[m, *b]): v for (m, kind, f, b), v in found.items()}


def test_tracks_are_those_of_full_matrices(spark):
    rows = detections()
    got = {(r.match_id, r.object_type, r.frame_idx, r.track_id): r for r in tracking.track(spark.createDataFrame(rows, DETECTION)).collect()}
    want = numbered(*plain_tracks(rows))
    assert {k[3] for k in want if k[0] == 1} != set(range(1, 1 + len({k[3] for k in want if k[0] == 1})))
    assert got.keys() == want.keys()
    assert len(want) > 500
    for k, (box, confidence, age, hits, missed) in want.items():
        r = got[k]
        assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx(box, abs=1e-6)
        assert (r.confidence, r.age, r.hits, r.time_since_update) == (confidence, age, hits, missed)


def test_tracker_runs_once(spark):
    plan = tracking.track(spark.createDataFrame(detections(frames=5), DETECTION))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    assert "Python" not in plan


def test_tracks_take_one_pass(spark, monkeypatch):
    """Frames and births are counted as the rows pass: only the tracks are written, and births of two types in one slot are two tracks."""
    names, saved = [], io.saved
    monkeypatch.setattr(io, "saved", lambda df, name, *a: names.append(name) or saved(df, name, *a))
    rows = [(1, f, f / 25, 0, kind, x, 0.0, x + 40.0, 90.0, 0.9) for f in range(0, 20, 2) for kind, x in (("ball", 10.0), ("player", 500.0))]
    # The second frame has two times; the lesser one counts.
    rows[2] = (*rows[2][:2], 7.5, *rows[2][3:])
    got = tracking.track(spark.createDataFrame(rows, DETECTION), min_hits=2).collect()
    assert names == ["tracks"]
    assert sorted((r.object_type, r.track_id, r.frame_idx, r.ts_s, r.hits) for r in got) == [(kind, i, f, f / 25, f // 2 + 1) for i, kind in ((1, "ball"), (2, "player")) for f in range(2, 20, 2)]


def test_shots_are_found_from_written_tracks(spark, monkeypatch):
    """The way from detections to shots ranks no frames and joins no ids: what is written is the tracks and the numbered path of the ball."""
    names, saved = [], io.saved
    monkeypatch.setattr(io, "saved", lambda df, name, *a: names.append(name) or saved(df, name, *a))
    rows = [(1, f, f / 25, 0, "ball", 100.0, 10.0 + 4 * f, 116.0, 26.0 + 4 * f, 0.9) for f in range(40)]
    (shot,) = queries._end_to_end(spark.createDataFrame(rows, DETECTION)).collect()
    assert (shot.target_goal, round(shot.speed, 2)) == ("bottom", 4.0)
    assert names == ["tracks", "sorted", "counts"]


def test_tracks_of_some_types_are_those_of_all(spark):
    """Other types' frames and times count though their boxes are left out; repeated, null and empty rows of the wanted type are kept as they are."""
    rows = detections(5)
    extra = [
        (1, 200, 8.0, 0, "ball", 5.0, 5.0, 21.0, 21.0, 0.9), (1, 201, 8.04, 0, "ball", 5.0, 5.0, 21.0, 21.0, float("nan")), (1, 202, 8.08, 0, "ball", 5.0, 5.0, 21.0, 21.0, None),
        (1, 203, 8.12, None, "ball", 5.0, 5.0, 21.0, 21.0, 0.9), (1, 204, 8.16, 3, None, 5.0, 5.0, 21.0, 21.0, 0.9), (1, 204, 8.17, 0, "ball", 5.0, 5.0, 21.0, 21.0, 0.9),
        (1, 205, None, 0, "ball", 5.0, 5.0, 21.0, 21.0, 0.9), (1, 205, 8.2, 4, "player", 5.0, 5.0, 21.0, 21.0, 0.9), (1, 206, None, 0, "ball", 5.0, 5.0, 21.0, 21.0, 0.9), (1, None, 8.3, 4, "player", 5.0, 5.0, 21.0, 21.0, 0.9),
        (None, 1, 0.0, 0, "ball", 5.0, 5.0, 21.0, 21.0, 0.9), *[(3, f, f / 25, s, "ball", 5.0, 5.0, 21.0, 21.0, 0.9) for f in range(6) for s in (0, 0, 1)], *[(4, f, f / 25, 0, "player", 5.0, 5.0, 45.0, 95.0, 0.9) for f in range(6)]]
    df = spark.createDataFrame(rows + extra, DETECTION)
    values = ["match_id", "object_type", "frame_idx", "ts_s", "x1", "y1", "x2", "y2", "confidence", "age", "hits", "time_since_update"]
    told = lambda r: tuple(str(r[c]) for c in values)
    for kinds in (("ball",), ("player",), ("ball", "player"), ("referee",)):
        every, some = (sorted(t.collect(), key=lambda r: (told(r), r.track_id)) for t in (tracking.track(df).filter(F.col("object_type").isin(*kinds)), tracking.track(df, kinds=kinds)))
        assert [told(r) for r in some] == [told(r) for r in every]
        # Births are counted among these types, in the same order.
        ids = collections.defaultdict(set)
        for a, b in zip(every, some, strict=True):
            ids[a.match_id].add((a.track_id, b.track_id))
        for pairs in ids.values():
            assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(sorted(pairs)))
    assert len(tracking.track(df, kinds=("ball",)).filter("match_id = 3").select("track_id").distinct().collect()) == 3


def test_shots_track_the_ball_alone(spark, monkeypatch):
    """Python gets the ball's rows and one row for all others of a frame."""
    seen, run = spark.sparkContext.accumulator(0), tracking._tracker

    def counting(*rules):
        inner = run(*rules)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return lambda batches: inner(count(batches))

    monkeypatch.setattr(tracking, "_tracker", counting)
    rows = [(1, f, f / 25, s, "ball" if s == 0 else "player", 100.0 * s, 10.0 + 4 * f, 100.0 * s + 16, 26.0 + 4 * f, 0.9) for f in range(40) for s in range(20)]
    (shot,) = queries._end_to_end(spark.createDataFrame(rows, DETECTION)).collect()
    assert (shot.target_goal, round(shot.speed, 2)) == ("bottom", 4.0)
    assert seen.value == 80


@pytest.mark.parametrize("ended", [False, True])
def test_live_tracks_are_those_of_the_table(spark, tmp_path, ended):
    """ended: a row of another match, far ahead, ends all matches before it."""
    rows = detections(2, 60)
    for k in range(3):
        # Files of twenty frames each, every one in disorder.
        part = [r for r in rows if r[1] // 20 == k]
        random.Random(k).shuffle(part)
        df = spark.createDataFrame([(*r, datetime.fromtimestamp(1000 + r[1] * 0.04, UTC)) for r in part], DETECTION + ", event_time timestamp")
        df.coalesce(1).write.mode("append").json(f"{tmp_path}/in{k}")
    late = spark.createDataFrame([(9, 0, 0.0, 0, "ball", 0.0, 0.0, 1.0, 1.0, 0.9, datetime.fromtimestamp(9000 if ended else 1100, UTC))], DETECTION + ", event_time timestamp")
    late.coalesce(1).write.json(f"{tmp_path}/in3")
    source = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").json(f"{tmp_path}/in[0-3]")
    out = live.track_stream(source).writeStream.format("memory").queryName(f"live_tracks_{ended}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    out.processAllAvailable()
    out.stop()
    got = {(r.match_id, r.object_type, r.frame_idx, r.track_id): (r.x1, r.age, r.hits, r.time_since_update) for r in spark.table(f"live_tracks_{ended}").collect()}
    want = {k: (v[0][0], *v[2:]) for k, v in numbered(*plain_tracks(rows)).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    table = {(r.match_id, r.object_type, r.frame_idx, r.track_id) for r in tracking.track(spark.createDataFrame(rows, DETECTION)).collect()}
    assert got.keys() == table
    # Match 9 waits for the watermark.
    state = {name: {r.key.match_id for r in spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/c").collect()} for name in ("live", "waiting")}
    assert state == {"live": set() if ended else {1, 2}, "waiting": {9}}


def test_a_replayed_table_gives_its_tracks(spark):
    """The whole of a finished table, streamed, equals the keyed job; so does a table with one frame, and none gives none."""
    df = spark.createDataFrame(detections(4, 40), DETECTION)
    names = ["match_id", "object_type", "frame_idx", "track_id", "age", "hits", "time_since_update"]
    for part in (df, df.filter("frame_idx = 3"), df.limit(0)):
        got = {tuple(r) for r in live.replay(part, min_hits=2).select(*names, F.round("x1", 6)).collect()}
        want = {tuple(r) for r in tracking.track(part, min_hits=2).select(*names, F.round("x1", 6)).collect()}
        assert got == want
    assert spark.conf.get(live.PROVIDER) == live.ROCKS


class Handle:
    """State and timers of one match, in memory, with counts of what is asked."""

    def __init__(self):
        self.value, self.found, self.timers, self.asked = None, {}, set(), collections.Counter()

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: self._set(v), clear=lambda: self._set(None))

    def getMapState(self, *_):  # noqa: N802
        return SimpleNamespace(keys=lambda: iter(list(self.found)), containsKey=self.found.__contains__, getValue=self.found.get, updateValue=lambda k, v: self._put(k, v), removeKey=self.found.pop)

    def _set(self, value):
        self.asked["live"] += 1
        self.value = value

    def _put(self, k, v):
        self.asked["waiting"] += 1
        self.found[k] = v

    def registerTimer(self, ms):  # noqa: N802
        self.asked["timers"] += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def test_frames_that_wait_share_a_timer(spark):
    """A watermark that passes 80 frames at once costs one timer and one writing of the live tracks; one within a bucket takes its first frames only."""
    rows = [r for r in detections(5, 100) if r[0] == 1]
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTION.split(", ")]).sample(frac=1, random_state=1)
    pdf["ms"] = 1_000_000 + pdf.frame_idx * 40
    pdf["event_time"] = pd.to_datetime(pdf["ms"], unit="ms")
    h, p, got = Handle(), live.LiveTracks(), []
    p.init(h)
    list(p.handleInputRows((1,), iter([pdf.iloc[:100], pdf.iloc[100:]]), None))
    assert h.asked["timers"] == 1
    assert h.asked["waiting"] == 4
    for at in (1_003_201, 9_000_000):
        assert (due := sorted(t for t in h.timers if t < at))
        h.timers -= set(due)
        h.asked.clear()
        got.append(pd.concat(list(p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda at=at: at), SimpleNamespace(getExpiryTimeInMs=lambda due=due: due[0])))))
        assert h.asked["live"] == 1
    assert (got[0].frame_idx.max(), got[1].frame_idx.min()) == (80, 81)
    assert (h.value, h.found) == (None, {})
    want = {(r.object_type, r.frame_idx, r.track_id, r.hits) for r in tracking.track(spark.createDataFrame(rows, DETECTION)).collect()}
    assert {(r.object_type, r.frame_idx, r.track_id, r.hits) for r in pd.concat(got).itertuples()} == want


def test_a_match_that_goes_on_after_its_end_is_a_new_one(spark, tmp_path):
    """Two stretches of one match with a pause longer than the idle time: ids begin at 1 twice, however the rows come."""
    rows = [r for r in detections(3, 20) if r[0] == 1]
    at = [*((r, 1000 + r[1] * 0.04) for r in rows), *(((r[0], r[1] + 50_000, *r[2:]), 3000 + r[1] * 0.04) for r in rows), ((9, 0, 0.0, 0, "ball", 0.0, 0.0, 1.0, 1.0, 0.9), 9000)]
    got = []
    for name, cuts in (("at_once", [at[:-1], at[-1:]]), ("in_turn", [at[: len(rows)], at[len(rows) : -1], at[-1:]])):
        for k, part in enumerate(cuts):
            df = spark.createDataFrame([(*r, datetime.fromtimestamp(t, UTC)) for r, t in part], DETECTION + ", event_time timestamp")
            df.coalesce(1).write.json(f"{tmp_path}/{name}{k}")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").json(f"{tmp_path}/{name}[0-3]")
        out = live.track_stream(source).writeStream.format("memory").queryName(f"live_{name}").option("checkpointLocation", f"{tmp_path}/c_{name}").outputMode("append").start()
        out.processAllAvailable()
        out.stop()
        got.append(sorted((r.frame_idx, r.track_id, r.hits, r.object_type) for r in spark.table(f"live_{name}").collect()))
    assert got[0] == got[1]
    early = {(f, i, h, o) for f, i, h, o in got[0] if f < 50_000}
    assert early == {(f - 50_000, i, h, o) for f, i, h, o in got[0] if f >= 50_000}
    assert early


def lloyd(points, centers, rounds=1000, eps=0.0):
    """Plain Lloyd steps from given centres: cost, centres, each point's number."""
    points, centers = np.array(points, dtype=float), np.array(centers, dtype=float)
    for _ in range(rounds):
        near = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        moved, centers = ((new - centers) ** 2).sum(axis=1).max(), new
        if moved <= eps * eps + 1e-18:
            break
    d = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    return d.min(axis=1).sum(), centers, d.argmin(axis=1)


def best_partition(points, k, tries=60):
    """The best of many plain starts at random points: cost and numbers by centre."""
    r, distinct = random.Random(11), sorted(set(points))
    k = min(k, len(distinct))
    cost, centers, near = min((lloyd(points, r.sample(distinct, k)) for _ in range(tries)), key=lambda x: x[0])
    order = sorted(range(k), key=lambda c: tuple(centers[c]))
    return cost, [tuple(centers[c]) for c in order], [order.index(c) for c in near]


@pytest.mark.parametrize("space", ["hsv", "bgr"])
def test_teams_are_those_of_plain_steps(spark, space):
    r, rows = random.Random(4), []
    for match in range(3):
        for track in range(14):
            base = (200, 40, 50) if track % 2 else (50, 60, 190)
            c = [min(255, max(0, v + r.gauss(0, 25))) for v in base]
            rows += [(match, track, *(v + d for v in c)) for d in (-2.0, 0.0, 2.0)]
    rows += [(7, t, 9.0, 9.0, 9.0) for t in range(3) for _ in range(3)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, b double, g double, r double")
    got = {(x.match_id, x.track_id): x.team_id for x in teams.assign_teams(df, space=space).collect()}
    mean = {x.match_id * 100 + x.track_id: x for x in teams.track_mean_color(df).collect()}
    for match in (0, 1, 2):
        tracks = range(14)
        if space == "bgr":
            points = [tuple(mean[match * 100 + t][c] for c in "bgr") for t in tracks]
        else:
            from trackframe.functions import color

            hsv = {x.track_id: tuple(x.c) for x in teams.track_mean_color(df).filter(F.col("match_id") == match).select("track_id", color.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).collect()}
            points = [hsv[t] for t in tracks]
        _, _, number = best_partition(points, 2)
        assert [got[match, t] for t in tracks] == number
    # Tracks of one colour are one team.
    assert {got[7, t] for t in range(3)} == {0}


def test_best_of_several_starts(spark):
    """Four far groups, two of them close to each other: a start with two centres in one far group ends in a poor optimum."""
    r = random.Random(3)
    groups = [(0, 0), (0, 30), (1000, 0), (1000, 30)]
    points = {key: [(x * (key + 1) + r.gauss(0, 3), y + r.gauss(0, 3)) for x, y in groups for _ in range(8)] for key in range(6)}
    df = spark.createDataFrame([(key, *p, 1.0 + (i % 3)) for key, ps in points.items() for i, p in enumerate(ps)], "key long, x double, y double, w double")
    got = {key: [] for key in points}
    for row in clusters.kmeans(df, ["key"], ["x", "y"], 4, "w").collect():
        got[row.key].append((row.cluster, row.x, row.y, row.w, row.c_x, row.c_y, row.n_points))
    poor = 0
    for key, ps in points.items():
        weighted = [p for i, p in enumerate(ps) for _ in range(1 + i % 3)]
        cost, centers, _ = best_partition(weighted, 4)
        assert sum(w * ((x - cx) ** 2 + (y - cy) ** 2) for _, x, y, w, cx, cy, _ in got[key]) == pytest.approx(cost)
        assert sorted({(c, x, y) for c, _, _, _, x, y, _ in got[key]}) == [(i, pytest.approx(c[0]), pytest.approx(c[1])) for i, c in enumerate(centers)]
        assert {c: n for c, *_, n in got[key]} == collections.Counter(c for c, _, _, w, *_ in got[key] for _ in range(int(w)))
        one = [lloyd(weighted, random.Random(s).sample(weighted, 4))[0] for s in range(20)]
        poor += max(one) > 2 * cost
    assert poor == len(points)


def test_draws_follow_the_weights(spark):
    """First draws of many keys: a value with nine tenths of the weight wins about nine tenths of the races."""
    df = spark.range(2000).select(F.col("id").alias("key"), F.explode(F.array(F.struct(F.array(F.lit(0.0)).alias("at"), F.lit(9.0).alias("w")), F.struct(F.array(F.lit(1.0)).alias("at"), F.lit(1.0).alias("w")))).alias("v")).select("key", "v.*")
    state = clusters.seeded(df, ["key"], 1, 1, 1, 42)
    heavy = state.filter("starts[0].centres[0][0] = 0.0").count()
    assert 1740 <= heavy <= 1860


REGIONS = {"full": (0.0, 1.0), "upper": (0.0, 0.4), "center": (0.3, 0.7)}


@pytest.mark.parametrize("region", [None, *REGIONS])
def test_dominant_colours_are_those_of_plain_steps(spark, region):
    """Boxes inside, over each edge, outside and empty; the sampled rows follow from the height before clipping."""
    r, size = random.Random(5), 20
    pixels = [(0, x, y, *(c + r.randint(0, 3) for c in r.choice([(10, 20, 30), (200, 10, 10), (90, 180, 40)]))) for x in range(size) for y in range(size)]
    pixels += [(1, x, y, 5, 6, 7 + 40 * (x > 3)) for x in range(10) for y in range(10)]
    areas = [(1, 0, 0, 0, 12, 9), (2, 0, 5, 5, 20, 20), (3, 1, 0, 0, 10, 10), (4, 1, 0, 0, 2, 9), (5, 0, -6, 3, 8, 17), (6, 0, 12, 2, 29, 18), (7, 0, 3, -8, 15, 12), (8, 0, 2, 8, 16, 31), (9, 0, 4, 4, 4, 9)]
    got = teams.dominant_color(
        spark.createDataFrame(pixels, "frame_idx long, x long, y long, b long, g long, r long"), spark.createDataFrame(areas, "box_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long"),
        region=region, size=(size, size))
    got = {x.box_id: ((x.b, x.g, x.r), x.n_points) for x in got.collect()}
    want = set()
    for box, frame, x1, y1, x2, y2 in areas:
        height, width, top = y2 - y1, x2 - x1, y2
        if region:
            x1, x2, y1, y2 = max(0, min(x1, size - 1)), max(0, min(x2, size)), max(0, min(y1, size - 1)), max(0, min(y2, size))
            lo, hi = REGIONS[region]
            y1, y2 = y1 + int(height * lo), min(y1 + int(height * hi) if region != "full" else top, y2)
        points = [tuple(map(float, p[3:])) for p in pixels if p[0] == frame and x1 <= p[1] < x2 and y1 <= p[2] < y2]
        if width <= 0 or not points:
            assert box not in got
            continue
        want.add(box)
        _, centers, number = best_partition(points, 3)
        count = collections.Counter(number)
        best = min(count, key=lambda c: (-count[c], c))
        assert got[box][1] == count[best]
        assert got[box][0] == pytest.approx(centers[best], abs=1e-6)
    assert got.keys() == want


def test_documents_in_their_own_layout(spark, tmp_path):
    """Indented, without a match_id, one per folder."""
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "video_metadata.json").write_text('{\n  "fps": 30.0,\n  "total_frames": 9,\n  "width": 1280,\n  "height": 720,\n  "duration": 0.3,\n  "codec": "avc1"\n}')
    (tmp_path / "run1" / "teams.json").write_text('{\n  "n_teams": 1,\n  "team_colors": {\n    "0": [\n      1.0,\n      2.0,\n      3.0\n    ]\n  },\n  "team_names": {\n    "0": "team_A"\n  },\n  "track_assignments": {\n    "5": 0\n  }\n}')
    (tmp_path / "run1" / "score_timeline.json").write_text('{\n  "goals": 1,\n  "final_score": {\n    "team_a": 1,\n    "team_b": 0\n  },\n  "timeline": [\n    {\n      "timestamp": 1.5,\n      "frame_idx": 45,\n      "score": {\n        "team_a": 1,\n        "team_b": 0\n      },\n      "confidence": 0.9,\n      "goal_region": "top"\n    }\n  ]\n}')
    (tmp_path / "run1" / "run_manifest.json").write_text('{\n  "schema_version": "1.0",\n  "video_path": "a.mp4",\n  "config": {\n    "sampling": {\n      "n": 10\n    }\n  },\n  "stages": [\n    "detect"\n  ]\n}')
    root = f"{tmp_path}/run1"
    (m,) = io.read_matches(spark, f"{root}/video_metadata.json").collect()
    assert (m.match_id, m.fps, m.total_frames, m.codec) == (None, 30.0, 9, "avc1")
    named, who = io.read_teams(spark, f"{root}/teams.json")
    assert [(r.team_id, r.team_name, r.b, r.r) for r in named.collect()] == [(0, "team_A", 1.0, 3.0)]
    assert [(r.team_id, r.track_id) for r in who.collect()] == [(0, 5)]
    assert [(r.ts_s, r.team_a, r.goal_region) for r in io.read_score(spark, f"{root}/score_timeline.json").collect()] == [(1.5, 1, "top")]
    (r,) = io.read_manifests(spark, f"{root}/run_manifest.json").collect()
    assert (r.schema_version, r.stages, r.config.replace(" ", "").replace("\n", "")) == ("1.0", ["detect"], '{"sampling":{"n":10}}')
    (r,) = runs.run_metadata(spark, str(tmp_path), "run1").collect()
    assert (r.video_metadata.height, r.manifest.video_path, r.teams.team_names) == (720, "a.mp4", {"0": "team_A"})
