import math

import pytest
from pyspark.sql import functions as F

from trackframe.functions import color, geometry
from trackframe.operators import boxes, events, path, teams, tracking
from trackframe.sources import io, runs

POINT = "match_id long, track_id long, frame_idx long, ts_s double, cx double, cy double, confidence double"


def _path(spark, points):
    rows = [(1, 1, f, f / 25.0, float(x), float(y), 0.9) for f, x, y in points]
    return path.velocity(path.numbered(spark.createDataFrame(rows, POINT)))


def test_known_boxes(spark):
    df = spark.createDataFrame([(100.0, 100.0, 200.0, 200.0), (50.0, 50.0, 100.0, 150.0)], "x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r)[4:] for r in boxes.box_geometry(df).collect()]
    assert got == [(150.0, 150.0, 100.0, 100.0, 10000.0), (75.0, 100.0, 50.0, 100.0, 5000.0)]


@pytest.mark.parametrize("text", ["#FF0000", "FF0000"])
def test_hex(spark, text):
    r = spark.range(1).select(color.hex_to_bgr(F.lit(text)).alias("c")).first().c
    assert (r.b, r.g, r.r) == (0, 0, 255)


@pytest.mark.parametrize(("bgr", "hsv"), [((0, 0, 255), (0, 255, 255)), ((0, 255, 0), (60, 255, 255)), ((255, 0, 0), (120, 255, 255)), ((7, 7, 7), (0, 0, 7)), ((0, 0, 0), (0, 0, 0))])
def test_hsv_both_ways(spark, bgr, hsv):
    lit = [F.lit(float(v)) for v in bgr]
    r = spark.range(1).select(color.bgr_to_hsv(*lit).alias("c")).first().c
    assert (r.h, r.s, r.v) == hsv
    r = spark.range(1).select(color.hsv_to_bgr(*[F.lit(float(v)) for v in hsv]).alias("c")).first().c
    assert (r.b, r.g, r.r) == bgr


def test_touching_boxes_do_not_overlap(spark):
    a, b = [F.lit(float(v)) for v in (0, 0, 10, 10)], [F.lit(float(v)) for v in (10, 0, 20, 10)]
    assert spark.range(1).select(geometry.iou(tuple(a), tuple(b)).alias("v")).first().v == 0


def test_bad_boxes_go(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (math.nan, 0.0, 1.0, 1.0), (0.0, -math.inf, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert boxes.valid_boxes(df).count() == 1


def test_short_paths(spark):
    assert _path(spark, [(0, 0, 0)]).first().vx is None
    two = _path(spark, [(0, 0, 0), (2, 10, 0)]).collect()
    assert [r.vx for r in two] == [5.0, 5.0]
    assert [r.vx for r in _path(spark, [(3, 0, 0), (3, 9, 0)]).collect()] == [0.0, 0.0]
    three = path.smooth(_path(spark, [(0, 0, 0), (1, 3, 0), (2, 9, 0)])).orderBy("row").collect()
    assert [round(r.vx, 6) for r in three] == [round((3 + 4.5) / 2, 6), round((3 + 4.5 + 6) / 3, 6), round((4.5 + 6) / 2, 6)]


def test_shot_needs_more_than_five_pixels(spark):
    up = _path(spark, [(i, 20 * i, 0) for i in range(6)] + [(6, 120, 5)])
    assert events.shots(up).count() == 0
    down = _path(spark, [(i, 20 * i, 0) for i in range(6)] + [(6, 120, 6)])
    assert events.shots(down).first().target_goal == "bottom"


def test_events_exactly_five_seconds_apart_share_a_window(spark):
    rows = [(1, 0, 0.0, 0.7), (1, 125, 5.0, 0.9), (1, 126, 5.04, 0.8), (1, 200, 8.0, 0.8), (2, 0, 0.0, 0.6)]
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, ts_s double, confidence double")
    assert sorted((r.match_id, r.frame_idx) for r in events.dedup_events(df).collect()) == [(1, 125), (1, 126), (2, 0)]


def test_recent_shot_takes_the_earliest_within_three_seconds(spark):
    points = spark.createDataFrame([(1, 75, 3.0, 25.0), (1, 76, 3.04, 25.0), (1, 400, 16.0, 25.0)], "match_id long, frame_idx long, ts_s double, fps double")
    shots = spark.createDataFrame([(1, 0, 0.0, 0.9, "top"), (1, 50, 2.0, 0.8, "top")], "match_id long, frame_idx long, ts_s double, confidence double, target_goal string")
    assert sorted((r.frame_idx, r.shot_frame) for r in events.recent_shot(points, shots).collect()) == [(75, 0), (76, 50)]


def test_tracker_invariants(spark):
    rows = []
    for f in range(60):
        if f not in range(20, 25):
            rows.append((1, f, f / 25.0, 0, "player", 10.0 + f, 10.0, 50.0 + f, 100.0, 0.9))
        rows.append((1, f, f / 25.0, 1, "ball", 500.0, 10.0 + f, 516.0, 26.0 + f, 0.4 if f % 5 == 4 else 0.8))
    df = spark.createDataFrame(rows, "match_id long, frame_idx long, ts_s double, slot long, object_type string, x1 double, y1 double, x2 double, y2 double, confidence double")
    out = tracking.track(df).collect()
    assert {(r.object_type, r.track_id) for r in out} == {("player", 1), ("ball", 2)}
    assert len({(r.track_id, r.frame_idx) for r in out}) == len(out)
    coasting = [r for r in out if r.object_type == "player" and r.time_since_update]
    assert [r.frame_idx for r in sorted(coasting, key=lambda r: r.frame_idx)] == list(range(20, 25))


def test_teams_part_by_colour(spark):
    rows = [(1, t, f, *((200.0 + f, 40.0, 40.0) if t % 2 else (40.0, 40.0, 200.0 + f))) for t in range(6) for f in range(4)] + [(2, 1, f, 9.0, 9.0, 9.0) for f in range(4)]
    out = teams.assign_teams(spark.createDataFrame(rows, "match_id long, track_id long, frame_idx long, b double, g double, r double")).collect()
    assert len(out) == 6
    assert len({(r.track_id % 2, r.team_id) for r in out}) == 2


def test_pixels_meet_boxes_over_tiles(spark):
    pixels = spark.range(0, 200 * 20).select(F.lit(0).alias("frame_idx"), (F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y"), *[F.lit(1).alias(c) for c in "bgr"])
    box = spark.createDataFrame([(7, 0, 50, 3, 140, 11), (8, 0, 5, 5, 5, 9)], "box_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long")
    assert teams.pixels_in_boxes(pixels, box, tile=16).count() == 90 * 8


def test_run_catalogue(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "video_metadata.json").write_text('{"fps": 25.0, "total_frames": 100, "width": 1920, "height": 1080, "duration": 4.0, "codec": "x"}')
    (tmp_path / "a" / "events.jsonl").write_text('{"event_type": "shot", "frame_idx": 1, "timestamp": 0.1, "confidence": 0.9}\n{"event_type": "goal", "frame_idx": 2, "timestamp": 0.2, "confidence": 0.9}\n')
    got = {r.run: r for r in runs.list_runs(spark, str(tmp_path)).collect()}
    assert (got["a"].has_events, got["a"].n_shot, got["a"].n_goal, got["a"].fps) == (True, 1, 1, 25.0)
    assert (got["b"].has_events, got["b"].n_shot, got["b"].width) == (False, 0, 1920)
    assert runs.run_events(spark, str(tmp_path), "a").first().n_events == 2


def test_file_round_trips(spark, tmp_path):
    e = spark.createDataFrame([(1, "shot", 3, 0.12, 0.5, 1.0, 2.0, 9.5)], "match_id long, event_type string, frame_idx long, ts_s double, confidence double, x double, y double, speed double")
    io.write_events(e, str(tmp_path / "e"))
    r = io.read_events(spark, str(tmp_path / "e")).first()
    assert (r.event_type, r.x, r.speed, r.goal_region) == ("shot", 1.0, 9.5, None)
