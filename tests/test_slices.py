"""Orders and windows that no single task holds give what windows over whole keys give."""

import collections
import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.operators import boxes, path, slices, tracking

POINT = "match_id long, track_id long, frame_idx long, ts_s double, cx double, cy double, confidence double"


def points(seed=1):
    """Paths of 1, 2 and many points, with repeated frames, gaps, stretches of speed and of rest."""
    r, rows = random.Random(seed), []
    for match, n in ((1, 1), (2, 2), (3, 40), (4, 203), (5, 7)):
        f, x, y, fast = 0, 500.0, 500.0, False
        for i in range(n):
            fast = not fast if r.random() < 0.15 else fast
            x, y = x + r.uniform(-1, 1) * (40 if fast else 3), y + r.uniform(-1, 1) * (40 if fast else 3)
            rows.append((match, i % 3, f, f / 25, x, y, 0.9))
            f += r.choice([0, 1, 1, 1, 2, 9])
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def paths(spark):
    return path.numbered(spark.createDataFrame(points(), POINT)).cache()


def same(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    assert a
    for k, row in a.items():
        assert row.keys() == b[k].keys()
        for c, v in row.items():
            assert b[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (k, c)


def test_row_numbers(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, None, 7]), r.choice([None, *range(30)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, part long")
    got = slices.row_numbers(df, ["key"], ["at", "part"], parts=9).collect()
    assert len(got) == len(rows)
    for key in (1, None, 7):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [(x.row, x.at, x.part, x.n) for x in sorted((x for x in got if x.key == key), key=lambda x: x.row)] == [(i, at, part, len(own)) for i, (_, at, part) in enumerate(own, 1)]


def test_dense_rank(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, None, 7]), r.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, at long, id long")
    got = {x.id: x.rank for x in slices.dense_rank(df, ["key"], ["at"], parts=7).collect()}
    want = {x.id: x.k for x in df.withColumn("k", F.dense_rank().over(W.partitionBy("key").orderBy("at"))).collect()}
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 50])
def test_windows_over_slices(paths, size):
    fast = path.velocity(paths)
    same(path.velocity(paths, size), fast, ["match_id", "row"])
    for window in (1, 3, 7):
        same(path.smooth(fast, window, size), path.smooth(fast, window), ["match_id", "row"])
    same(path.direction_changes(fast, 45.0, size), path.direction_changes(fast), ["match_id", "row"])
    goal = fast.withColumn("goal_region", F.when(F.col("row") % 5 < 2, "top")).withColumn("height", F.lit(1000))
    same(path.stays_in_goal(goal, size=size), path.stays_in_goal(goal), ["match_id", "row"])


def test_velocity_is_that_of_plain_differences(paths):
    rows = collections.defaultdict(list)
    for p in sorted(points(), key=lambda p: (p[0], p[2], p[1])):
        rows[p[0]].append(p)
    got = {(r.match_id, r.row): (r.vx, r.vy) for r in path.velocity(paths, 4).collect()}
    for match, own in rows.items():
        for i in range(len(own)):
            a, b = own[max(0, i - 1)], own[min(len(own) - 1, i + 1)]
            dt = b[2] - a[2]
            want = (None, None) if len(own) < 2 else ((b[4] - a[4]) / dt, (b[5] - a[5]) / dt) if dt > 0 else (0.0, 0.0)
            assert got[match, i + 1] == (want if want[0] is None else pytest.approx(want))


@pytest.mark.parametrize("size", [1, 4, 32, 10_000])
def test_runs_are_merged_over_slices(spark, paths, size):
    """Runs that end at, begin at and span borders of slices, against one pass in order."""
    for least in (1, 2, 3):
        fast = path.velocity(paths)
        want = {}
        for match, own in ((m, sorted((r for r in fast.collect() if r.match_id == m), key=lambda r: r.row)) for m in (1, 2, 3, 4, 5)):
            run = []
            for r in [*own, None]:
                if r is not None and r.speed is not None and r.speed >= 2:
                    run.append(r)
                    continue
                if len(run) >= least:
                    angles = [math.atan2(x.vy, x.vx) for x in run]
                    mean = sum(angles) / len(angles)
                    want[match, run[0].row] = (run[-1].row, len(run), sum(x.speed for x in run) / len(run), (sum((a - mean) ** 2 for a in angles) / len(run)) ** 0.5)
                run = []
        got = {(r.match_id, r.first_row): (r.last_row, r.n_points, r.avg_speed, r.angle_std) for r in path.fast_segments(fast, 2.0, least, size).collect()}
        assert got.keys() == want.keys()
        assert max(v[1] for v in want.values()) > 8
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-6)


def test_no_window_over_a_match(spark, paths):
    """No window over the rows of a match: those of ranks run over counts of parts, all others per slice."""
    det = spark.createDataFrame([(1, i, i, "ball", 0.0) for i in range(50)], "match_id long, frame_idx long, slot long, object_type string, x1 double")
    for df in (tracking.ticked(det), boxes.sample_present_frames(det), path.velocity(paths), path.smooth(path.velocity(paths)), path.direction_changes(path.velocity(paths))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("slice" in line for line in windows), windows
