"""A query per operator, and the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trackframe.functions import color as C
from trackframe.functions import geometry as G
from trackframe.operators import boxes, display, events, path, reports, teams, tracking
from trackframe.plans.fixtures import FIXTURES, fx
from trackframe.plans.registry import ORACLE, QUERIES, oracle, query, rounded
from trackframe.sources import io, runs
from trackframe.streaming import live

KEY = "match_id, frame_idx, slot"
BOX = ("x1", "y1", "x2", "y2")
CENTERS = [(0, (210.0, 45.0, 50.0)), (1, (50.0, 45.0, 210.0))]


def _ball(b):
    return path.velocity(path.numbered(b))


def _python_medians(b, g, r):
    """A caller's own aggregate: Python that gets all pixels of a box."""

    def median(v: pd.Series) -> float:
        return float(v.median())

    own = F.pandas_udf(median, "double")
    return {"b": own(b), "g": own(g), "r": own(r)}


def _smooth(b):
    return path.smooth(_ball(b))


def _shifted(d):
    """Boxes moved over every edge of the frame, some without height."""
    dx, dy = (F.col("frame_idx") % 5 - 2) * 480.5, (F.col("frame_idx") % 7 - 3) * 180.5
    y2 = F.when(F.col("frame_idx") % 11 == 0, F.col("y1")).otherwise(F.col("y2"))
    return d.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": y2 + dy})


def _adder(field):
    return lambda a, x: a + x[field]


def _present(d):
    """Rows of every 30th frame that a match has."""
    return boxes.sample_present_frames(d)


# ---- boxes -------------------------------------------------------------------------------------------------------
query("B1_box_geometry", f"SELECT {KEY.replace('slot', 'i(slot) AS slot')}, r((x1 + x2) / 2) AS cx, r((y1 + y2) / 2) AS cy, r(x2 - x1) AS width, r(y2 - y1) AS height, r((x2 - x1) * (y2 - y1)) AS area FROM fx_det", "fx_det")(
    lambda d: boxes.box_geometry(d).select("match_id", "frame_idx", "slot", "cx", "cy", "width", "height", "area"))
query("B2_classify_boxes", "SELECT match_id, frame_idx, i(slot) AS slot, CASE class_id WHEN 0 THEN 'player' WHEN 32 THEN 'ball' END AS object_type, r(confidence) AS confidence FROM fx_det WHERE class_id IN (0, 32) AND confidence >= 0.5", "fx_det")(
    lambda d: boxes.classify_boxes(d.drop("object_type")).select("match_id", "frame_idx", "slot", "object_type", "confidence"))
query("B3_sample_frames", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE frame_idx >= 5 AND frame_idx < 900 AND frame_idx % 10 = 0", "fx_det")(
    lambda d: boxes.sample_frames(d, "every_nth", 10, 5, 900).select("match_id", "frame_idx", "slot"))
query("B3_sample_every_2nd", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE frame_idx % 2 = 0", "fx_det")(
    lambda d: boxes.sample_frames(d, "every_2nd").select("match_id", "frame_idx", "slot"))
query("B4_with_time", "SELECT d.match_id, d.frame_idx, i(slot) AS slot, r(d.frame_idx / fps) AS ts_s FROM fx_det d JOIN fx_match m ON d.match_id = m.match_id", "fx_det", "fx_match")(
    lambda d, m: boxes.with_time(d.drop("ts_s"), m).select("match_id", "frame_idx", "slot", "ts_s"))
query("B4_frame_at", "SELECT d.match_id, i(floor((ts_s + 0.01) * fps)) AS frame_idx, i(slot) AS slot FROM fx_det d JOIN fx_match m ON d.match_id = m.match_id", "fx_det", "fx_match")(
    lambda d, m: boxes.with_frame(d.drop("frame_idx").withColumn("ts_s", F.col("ts_s") + 0.01), m).select("match_id", "frame_idx", "slot"))
query("B5_sample_present_frames", "SELECT match_id, frame_idx, track_id FROM (SELECT *, dense_rank() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM fx_trk) WHERE (k - 1) % 30 = 0", "fx_trk")(
    lambda t: boxes.sample_present_frames(t).select("match_id", "frame_idx", "track_id"))
query("B6_players", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE object_type = 'player'", "fx_det")(lambda d: boxes.players(d).select("match_id", "frame_idx", "slot"))
query("B6_balls", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE object_type = 'ball'", "fx_det")(lambda d: boxes.balls(d).select("match_id", "frame_idx", "slot"))
query("B6_events_of", "SELECT match_id, frame_idx, r(confidence) AS confidence FROM fx_evt WHERE event_type = 'goal'", "fx_evt")(lambda e: boxes.events_of(e, "goal").select("match_id", "frame_idx", "confidence"))
query("B6_team", "SELECT match_id, frame_idx, track_id FROM fx_trk WHERE team_name = 'team_A'", "fx_trk")(lambda t: boxes.team(t, "team_A").select("match_id", "frame_idx", "track_id"))
query("B7_time_slice", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE ts_s <= 10.0", "fx_det")(lambda d: boxes.time_slice(d, 10.0).select("match_id", "frame_idx", "slot"))
query("B8_high_conf_ball", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE object_type = 'ball' AND confidence > 0.8", "fx_det")(lambda d: boxes.high_conf(d).select("match_id", "frame_idx", "slot"))
query("B8_high_conf_events", "SELECT match_id, frame_idx FROM fx_evt WHERE confidence > 0.8", "fx_evt")(lambda e: boxes.high_conf(e, None).select("match_id", "frame_idx"))
query("B8_large", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE object_type = 'player' AND (x2 + frame_idx % 30 - x1) * (y2 - y1) > 5000", "fx_det")(
    lambda d: boxes.large(d.withColumn("x2", F.col("x2") + F.col("frame_idx") % 30), area=5000).select("match_id", "frame_idx", "slot"))
query("B9_valid_boxes", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE frame_idx % 7 NOT IN (0, 3)", "fx_det")(
    lambda d: boxes.valid_boxes(d.withColumn("x1", F.when(F.col("frame_idx") % 7 == 0, float("nan")).when(F.col("frame_idx") % 7 == 3, float("-inf")).otherwise(F.col("x1")))).select("match_id", "frame_idx", "slot"))
query("B10_player_centers", "SELECT match_id, track_id, frame_idx, r(ts_s) AS ts_s, r((x1 + x2) / 2) AS cx, r((y1 + y2) / 2) AS cy, team_name FROM fx_trk WHERE object_type = 'player'", "fx_trk")(boxes.player_centers)
query("B11_goal_regions", """SELECT match_id, 'top' AS name, r(width * 0.35) AS x_min, r(width * 0.65) AS x_max, r(0.0) AS y_min, r(height * 0.15) AS y_max FROM fx_match
UNION ALL SELECT match_id, 'bottom', r(width * 0.35), r(width * 0.65), r(height * 0.85), r(height * 1.0) FROM fx_match""", "fx_match")(boxes.goal_regions)
REGION_SQL = "CASE WHEN cx >= 1920 * 0.35 AND cx <= 1920 * 0.65 AND cy >= 0 AND cy <= 1080 * 0.15 THEN 'top' WHEN cx >= 1920 * 0.35 AND cx <= 1920 * 0.65 AND cy >= 1080 * 0.85 AND cy <= 1080 THEN 'bottom' END"
query("B12_goal_region_of", f"SELECT match_id, frame_idx, {REGION_SQL} AS region FROM fx_ball", "fx_ball")(
    lambda b: b.select("match_id", "frame_idx", G.goal_region_of(F.col("cx"), F.col("cy"), F.lit(1920), F.lit(1080)).alias("region")))
query("B13_near_edge", "SELECT match_id, frame_idx, cx < 192 OR cx > 1920 - 192 OR cy < 108 OR cy > 1080 - 108 AS near FROM fx_ball", "fx_ball")(
    lambda b: b.select("match_id", "frame_idx", G.near_edge(F.col("cx"), F.col("cy"), F.lit(1920), F.lit(1080)).alias("near")))
query("B14_label_text", "SELECT match_id, frame_idx, track_id, concat_ws(' ', object_type, printf('%.2f', confidence + 0.001), 'ID:' || track_id) AS label FROM fx_trk", "fx_trk")(
    lambda t: display.label_text(t.withColumn("confidence", F.col("confidence") + 0.001)).select("match_id", "frame_idx", "track_id", "label"))
query("B15_display_color", """SELECT match_id, frame_idx, track_id, CASE WHEN object_type = 'ball' THEN '0,0,255' WHEN object_type <> 'player' THEN '128,128,128' WHEN slot % 3 = 0 THEN '255,0,0' WHEN slot % 3 = 1 THEN '0,0,255' ELSE '0,255,0' END AS color
FROM (SELECT match_id, frame_idx, track_id, track_id % 100 AS slot, CASE WHEN track_id % 100 = 5 THEN 'referee' ELSE object_type END AS object_type FROM fx_trk)""", "fx_trk")(
    lambda t: display.display_color(t.withColumns({
        "team_name": F.get(F.lit(["ours", "opponent", "unknown"]), (F.col("track_id") % 100 % 3).cast("int")),
        "object_type": F.when(F.col("track_id") % 100 == 5, "referee").otherwise(F.col("object_type"))})).select("match_id", "frame_idx", "track_id", "color"))
query("B16_event_display", """SELECT e.match_id, frame_idx, CAST(floor(ts_s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(ts_s % 60) AS BIGINT) AS VARCHAR), 2, '0') AS clock,
r(ts_s / CASE WHEN e.match_id % 3 = 0 OR coalesce(duration, 0) = 0 THEN 1 ELSE duration END * 100) AS marker, confidence >= 0.7 AS high,
CASE WHEN event_type = 'shot' THEN CASE WHEN round(speed) <> 0 THEN 'Speed: ' || printf('%.1f', round(speed) + 0.3) || 'px/f' ELSE '' END || ' • Target: ' ELSE ' • Region: ' END || region AS details
FROM fx_evt e LEFT JOIN fx_match m ON e.match_id = m.match_id""", "fx_evt", "fx_match")(
    lambda e, m: display.event_display(
        e.withColumn("speed", F.when(F.round("speed") != 0, F.round("speed") + 0.3).otherwise(0.0)), m.withColumn("duration", F.when(F.col("match_id") % 3 == 0, 0.0).otherwise(F.col("duration"))),
    ).select("match_id", "frame_idx", "clock", "marker", "high", "details"))
query("B17_event_fields", """SELECT match_id, frame_idx, CASE WHEN event_type = 'shot' THEN printf('%.1f', round(speed) + 0.3) ELSE 'N/A' END AS speed_text, CASE WHEN event_type = 'shot' THEN region ELSE 'unknown' END AS target_text,
CASE WHEN event_type = 'goal' THEN region ELSE 'unknown' END AS region_text, 'no shot' AS shot_text FROM fx_evt""", "fx_evt")(
    lambda e: display.event_fields(e.withColumns({
        "target_goal": F.when(F.col("event_type") == "shot", F.col("region")), "goal_region": F.when(F.col("event_type") == "goal", F.col("region")),
        "speed": F.when(F.col("event_type") == "shot", F.round("speed") + 0.3), "shot_timestamp": F.lit(None).cast("double")})).select("match_id", "frame_idx", "speed_text", "target_text", "region_text", "shot_text"))
#: Boxes over every edge, and empty ones; heights and widths of the box, low and high ends within the frame.
RECT_SQL = """b AS (SELECT match_id, frame_idx, slot, trunc(x1 + dx) AS a, trunc(y1 + dy) AS b, trunc(x2 + dx) AS c, trunc(CASE WHEN frame_idx % 11 = 0 THEN y1 ELSE y2 END + dy) AS d
FROM (SELECT *, (frame_idx % 5 - 2) * 480.5 AS dx, (frame_idx % 7 - 3) * 180.5 AS dy FROM fx_det)),
q AS (SELECT *, d - b AS h, greatest(0, least(a, 1919)) AS lx, greatest(0, least(b, 1079)) AS ly, greatest(0, least(c, 1920)) AS hx, greatest(0, least(d, 1080)) AS hy FROM b WHERE d > b AND c > a)"""
for _region, _low, _high in (("upper", "ly", "least(ly + trunc(h * 0.4), hy)"), ("center", "ly + trunc(h * 0.3)", "least(ly + trunc(h * 0.7), hy)"), ("full", "ly", "hy")):
    query(f"B18_sample_rect_{_region}", f"WITH {RECT_SQL} SELECT match_id, frame_idx, i(slot) AS slot, i(lx) AS rx1, i({_low}) AS ry1, i(hx) AS rx2, i({_high}) AS ry2 FROM q", "fx_det")(
        lambda d, region=_region: _shifted(d).select("match_id", "frame_idx", "slot", C.sample_rect(*[F.col(c) for c in BOX], F.lit(1920), F.lit(1080), region).alias("rect")).filter("rect IS NOT NULL").select("match_id", "frame_idx", "slot", "rect.*"))
query("B19_valid_colors", "SELECT match_id, frame_idx, i(slot) AS slot FROM fx_det WHERE frame_idx % 5 <> 0", "fx_det")(
    lambda d: teams.valid_colors(d.withColumns({c: F.when(F.col("frame_idx") % 5 == 0, 1e-9).otherwise(F.col(c)) for c in "bgr"})).select("match_id", "frame_idx", "slot"))

# ---- joins -------------------------------------------------------------------------------------------------------
query("C1_label_tracks", "SELECT match_id, track_id, frame_idx, i(CASE WHEN track_id % 3 = 0 THEN -1 ELSE team_id END) AS team_id, CASE WHEN track_id % 3 = 0 THEN 'unknown' ELSE team_name END AS team_name FROM fx_trk", "fx_trk")(
    lambda t: teams.label_tracks(t, t.filter("track_id % 3 <> 0").select("match_id", "track_id", "team_id").distinct(), t.select("match_id", "team_id", "team_name").distinct()).select("match_id", "track_id", "frame_idx", "team_id", "team_name"))
query("C2_with_match", "SELECT d.match_id, frame_idx, i(slot) AS slot, i(width) AS width, i(height) AS height, r(fps) AS fps FROM fx_det d JOIN fx_match m ON d.match_id = m.match_id", "fx_det", "fx_match")(
    lambda d, m: boxes.with_match(d, m).select("match_id", "frame_idx", "slot", "width", "height", "fps"))
IOU_SQL = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
query("C3_iou_pairs", f"""WITH d AS MATERIALIZED (SELECT match_id, frame_idx, object_type, list(struct_pack(slot := slot, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS boxes FROM fx_det GROUP BY ALL),
k AS (SELECT l.match_id, l.frame_idx AS pair_frame, l.object_type, l.boxes AS own, n.boxes AS following FROM d l JOIN d n ON n.match_id = l.match_id AND n.frame_idx = l.frame_idx + 1 AND n.object_type = l.object_type),
u AS (SELECT match_id, pair_frame, object_type, unnest(own) AS a, following FROM k),
v AS (SELECT match_id, pair_frame, object_type, a, unnest(following) AS b FROM u),
j AS (SELECT match_id, pair_frame, object_type, a.slot AS a_slot, b.slot AS b_slot, {IOU_SQL} AS i_, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s_ FROM v WHERE a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT match_id, pair_frame, object_type, i(a_slot) AS a_slot, i(b_slot) AS b_slot, r(i_ / (s_ - i_)) AS iou FROM j WHERE i_ / (s_ - i_) >= 0.3""", "fx_det")(
    lambda d: boxes.iou_pairs(d.withColumn("pair_frame", F.col("frame_idx")), d.withColumn("pair_frame", F.col("frame_idx") - 1)))
query("C4_recent_shot", """WITH s AS (SELECT * FROM fx_evt WHERE event_type = 'shot'),
j AS (SELECT g.match_id, g.frame_idx, min(s.frame_idx) AS shot_frame FROM fx_evt g JOIN s ON g.match_id = s.match_id AND (g.frame_idx - s.frame_idx) / 25.0 BETWEEN 0 AND 3 WHERE g.event_type = 'goal' GROUP BY ALL)
SELECT match_id, frame_idx, shot_frame FROM j""", "fx_evt")(
    lambda e: events.recent_shot(e.filter("event_type = 'goal'").withColumn("fps", F.lit(25.0)).select("match_id", "frame_idx", "ts_s", "fps"), e.filter("event_type = 'shot'").withColumn("target_goal", F.col("region"))).select("match_id", "frame_idx", "shot_frame"))
query("C6_pixels_in_boxes", "SELECT box_id, p.frame_idx, x, y, b, g, r FROM fx_pixel p JOIN fx_box q ON p.frame_idx = q.frame_idx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2", "fx_pixel", "fx_box")(teams.pixels_in_boxes)
query("C7_color_samples", """WITH k AS (SELECT *, (dense_rank() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1) % 30 = 0 AS sampled FROM fx_trk)
SELECT match_id, track_id, frame_idx FROM k WHERE sampled AND object_type = 'player' AND track_id % 5 <> 2""", "fx_trk")(
    lambda t: teams.color_samples(t.withColumn("y2", F.when(F.col("track_id") % 5 == 2, float("nan")).otherwise(F.col("y2"))), _present(t).select("match_id", "frame_idx").distinct()).select("match_id", "track_id", "frame_idx"))
query("C8_busy_frame_times", """WITH b AS (SELECT match_id, frame_idx, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM (SELECT match_id, frame_idx FROM fx_det WHERE object_type = 'player' GROUP BY ALL HAVING count(*) > 15))
SELECT DISTINCT d.match_id, d.frame_idx, r(ts_s) AS ts_s FROM fx_det d JOIN b ON d.match_id = b.match_id AND d.frame_idx = b.frame_idx WHERE k <= 5""", "fx_det")(lambda d: reports.busy_frame_times(d, 15))
HSV_SQL = """h AS (SELECT *, floor(CASE WHEN mx = mn THEN 0 WHEN mx = r_ THEN CASE WHEN g_ < b_ THEN 360 + 60.0 * (g_ - b_) / (mx - mn) ELSE 60.0 * (g_ - b_) / (mx - mn) END
WHEN mx = g_ THEN 120 + 60.0 * (b_ - r_) / (mx - mn) ELSE 240 + 60.0 * (r_ - g_) / (mx - mn) END / 2 + 0.5) % 180 AS h, CASE WHEN mx = 0 THEN 0 ELSE floor(255.0 * (mx - mn) / mx + 0.5) END AS s, mx AS v FROM m)"""
query("C10_predict_team", f"""WITH m AS (SELECT *, b AS b_, g AS g_, r AS r_, greatest(b, g, r) AS mx, least(b, g, r) AS mn FROM fx_det), {HSV_SQL},
k AS (SELECT match_id, frame_idx, slot, sqrt(pow(2 * least(abs(h - 121), 180 - abs(h - 121)), 2) + pow(s - 200, 2) + pow(v - 210, 2)) AS d0, sqrt(pow(2 * least(abs(h - 179), 180 - abs(h - 179)), 2) + pow(s - 200, 2) + pow(v - 210, 2)) AS d1 FROM h)
SELECT match_id, frame_idx, i(slot) AS slot, i(CASE WHEN d0 <= d1 THEN 0 ELSE 1 END) AS team_id, r(least(d0, d1)) AS distance FROM k""", "fx_det")(
    lambda d: teams.predict_team(d, CENTERS).select("match_id", "frame_idx", "slot", "team_id", "distance"))

# ---- aggregates --------------------------------------------------------------------------------------------------
query("D1_detection_totals", "SELECT match_id, i(count(*)) AS n_rows, i(count(DISTINCT frame_idx)) AS n_frames, r(min(ts_s)) AS first_s, r(max(ts_s)) AS last_s, r(max(ts_s) / 60) AS minutes FROM fx_det GROUP BY match_id", "fx_det")(reports.detection_totals)
query("D2_type_counts", "SELECT match_id, object_type, i(count(*)) AS n FROM fx_det GROUP BY ALL", "fx_det")(reports.type_counts)
query("D3_per_frame_stats", "SELECT match_id, r(avg(c)) AS mean_rows, r(median(c)) AS median_rows FROM (SELECT match_id, frame_idx, count(*) AS c FROM fx_det GROUP BY ALL) GROUP BY match_id", "fx_det")(reports.per_frame_stats)
DESCRIBE = "i(count({c})) AS n, r(avg({c})) AS mean, r(stddev_samp({c})) AS std, r(min({c})) AS lowest, r(quantile_cont({c}, 0.25)) AS p25, r(quantile_cont({c}, 0.5)) AS p50, r(quantile_cont({c}, 0.75)) AS p75, r(max({c})) AS highest"
query("D4_describe_confidence", f"SELECT match_id, object_type, {DESCRIBE.format(c='confidence')} FROM fx_det GROUP BY ALL", "fx_det")(reports.describe_by)
query("D5_ball_rate", "SELECT match_id, i(count(*) FILTER (object_type = 'ball')) AS n_balls, r(100.0 * count(*) FILTER (object_type = 'ball') / count(DISTINCT frame_idx)) AS ball_rate FROM fx_det GROUP BY match_id", "fx_det")(reports.ball_rate)
query("D6_frame_summary", "SELECT match_id, frame_idx, count(*) FILTER (object_type = 'player') || ' players, ' || count(*) FILTER (object_type = 'ball') || ' balls' AS objects, r(arg_min(ts_s, slot)) AS ts_s, r(avg(confidence)) AS mean_confidence FROM fx_det GROUP BY match_id, frame_idx", "fx_det")(reports.frame_summary)
query("D7_busy_frames", "SELECT match_id, frame_idx, i(count(*)) AS n_players FROM fx_det WHERE object_type = 'player' GROUP BY ALL HAVING count(*) > 15", "fx_det")(lambda d: reports.busy_frames(d, 15))
query("D8_track_totals", "SELECT match_id, i(count(*)) AS n_points, i(count(DISTINCT track_id)) AS n_tracks, i(count(DISTINCT frame_idx)) AS n_frames, r(min(ts_s)) AS first_s, r(max(ts_s)) AS last_s FROM fx_trk GROUP BY match_id", "fx_trk")(reports.track_totals)
query("D9_tracks_by_type", "SELECT match_id, object_type, i(count(DISTINCT track_id)) AS n_tracks FROM fx_trk GROUP BY ALL", "fx_trk")(reports.tracks_by_type)
LEN = "(SELECT match_id, track_id, count(*) AS length FROM fx_trk GROUP BY ALL)"
query("D10_track_length_stats", f"SELECT match_id, r(avg(length)) AS mean_length, r(median(length)) AS median_length, i(max(length)) AS longest, i(min(length)) AS shortest FROM {LEN} GROUP BY match_id", "fx_trk")(reports.track_length_stats)
query("D11_track_quality", "SELECT match_id, r(avg(confidence)) AS mean_confidence, r(avg(hits)) AS mean_hits, r(avg(age)) AS mean_age FROM fx_trk GROUP BY match_id", "fx_trk")(reports.track_quality)
query("D12_long_tracks", f"SELECT match_id, i(count(*)) AS n_long, array_to_string(list_slice(list_sort(list(track_id)), 1, 10), ',') AS first_ids FROM {LEN} WHERE length > 100 GROUP BY match_id", "fx_trk")(reports.long_tracks)
query("D12_short_tracks", f"SELECT match_id, i(count(*)) AS n_short FROM {LEN} WHERE length < 10 GROUP BY match_id", "fx_trk")(reports.short_tracks)
query("D13_ball_track_stats", f"SELECT match_id, 'ball' AS object_type, {DESCRIBE.format(c='length').replace('r(min(length))', 'i(min(length))').replace('r(max(length))', 'i(max(length))')} FROM (SELECT match_id, track_id, count(*) AS length FROM fx_trk WHERE object_type = 'ball' GROUP BY ALL) GROUP BY match_id", "fx_trk")(reports.ball_track_stats)
query("D14_track_summary", "SELECT match_id, track_id, arg_min(object_type, frame_idx) AS object_type_first, min(frame_idx) AS frame_idx_min, max(frame_idx) AS frame_idx_max, i(count(frame_idx)) AS frame_idx_count, r(min(ts_s)) AS timestamp_min, r(max(ts_s)) AS timestamp_max, r(avg(confidence)) AS confidence_mean, i(max(hits)) AS hits_max, i(max(age)) AS age_max FROM fx_trk GROUP BY match_id, track_id", "fx_trk")(reports.track_summary)
query("D15_fragmentation", "SELECT match_id, r(ratio) AS ratio, CASE WHEN ratio > 0.5 THEN 'Good' WHEN ratio > 0.2 THEN 'Moderate' ELSE 'Poor' END AS grade FROM (SELECT match_id, count(*)::DOUBLE / count(DISTINCT track_id) / count(DISTINCT frame_idx) AS ratio FROM fx_trk GROUP BY match_id)", "fx_trk")(reports.fragmentation)
query("D16_coverage", "SELECT match_id, r(count(*)::DOUBLE / count(DISTINCT frame_idx)) AS coverage FROM fx_trk GROUP BY match_id", "fx_trk")(reports.coverage)
query("D17_team_roster", "SELECT match_id, i(team_id) AS team_id, team_name, i(count(DISTINCT track_id)) AS n_tracks FROM fx_trk WHERE team_id >= 0 GROUP BY ALL", "fx_trk")(
    lambda t: teams.team_roster(t.filter("team_id >= 0").select("match_id", "team_id", "team_name").distinct(), t.filter("team_id >= 0").select("match_id", "team_id", "track_id").distinct()))
query("D18_team_counts", "SELECT match_id, team_name, i(count(DISTINCT track_id)) AS n_tracks, i(count(*)) AS n_points FROM fx_trk GROUP BY ALL", "fx_trk")(reports.team_counts)
query("D19_track_lengths_by_team", "SELECT match_id, track_id, team_name, i(count(*)) AS length FROM fx_trk GROUP BY ALL", "fx_trk")(lambda t: reports.track_lengths(t, "team_name"))
query("D20_team_inconsistencies", "SELECT match_id, track_id, i(count(DISTINCT CASE WHEN frame_idx % 50 = 7 THEN 9 ELSE team_id END)) AS n_teams FROM fx_trk GROUP BY ALL HAVING count(DISTINCT CASE WHEN frame_idx % 50 = 7 THEN 9 ELSE team_id END) > 1", "fx_trk")(
    lambda t: reports.team_inconsistencies(t.withColumn("team_id", F.when(F.col("frame_idx") % 50 == 7, 9).otherwise(F.col("team_id")))))
query("D21_team_summary", "SELECT match_id, i(team_id) AS team_id, team_name, i(count(DISTINCT track_id)) AS track_id_nunique, min(frame_idx) AS frame_idx_min, max(frame_idx) AS frame_idx_max, i(count(frame_idx)) AS frame_idx_count, r(avg(confidence)) AS confidence_mean FROM fx_trk GROUP BY match_id, team_id, team_name", "fx_trk")(reports.team_summary)
query("D22_team_balance", "SELECT match_id, r(max(n)::DOUBLE / min(n)) AS ratio, max(n)::DOUBLE / min(n) > 1.5 AS imbalanced FROM (SELECT match_id, team_name, count(DISTINCT track_id) AS n FROM fx_trk WHERE team_name <> 'unknown' GROUP BY ALL) GROUP BY match_id HAVING count(*) = 2", "fx_trk")(
    lambda t: reports.team_balance(t.filter("team_name <> 'unknown'")))
query("D23_event_counts", "SELECT match_id, event_type, i(count(*)) AS n FROM fx_evt GROUP BY ALL", "fx_evt")(lambda e: reports.type_counts(e, "event_type"))
query("D23_describe_events", f"SELECT match_id, event_type, {DESCRIBE.format(c='confidence')} FROM fx_evt GROUP BY ALL", "fx_evt")(lambda e: reports.describe_by(e, "event_type"))
query("D24_event_health", "SELECT match_id, false AS no_events, count(*) FILTER (event_type = 'shot') > 0 AND count(*) FILTER (event_type = 'goal') = 0 AS no_goals, count(*) FILTER (event_type = 'goal') > 10 AS many_goals, count(*) FILTER (confidence < 0.5) > 0.5 * count(*) AS low_confidence FROM fx_evt GROUP BY match_id", "fx_evt", "fx_match")(
    lambda e, m: reports.health_of(m, e))
query("D25_event_type_counts", "SELECT match_id, i(count(*) FILTER (event_type = 'shot')) AS n_shot, i(count(*) FILTER (event_type = 'goal')) AS n_goal, i(count(*) FILTER (event_type = 'other')) AS n_other FROM fx_evt GROUP BY match_id", "fx_evt")(reports.event_type_counts)
query("D26_track_mean_color", """WITH k AS (SELECT *, (dense_rank() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1) % 30 = 0 AS sampled FROM fx_det)
SELECT match_id, i(slot) AS track_id, r(avg(b)) AS b, r(avg(g)) AS g, r(avg(r)) AS r, i(count(*)) AS n_samples FROM k WHERE sampled GROUP BY match_id, slot HAVING count(*) >= 3""", "fx_det")(
    lambda d: teams.track_mean_color(_present(d).withColumn("track_id", F.col("slot"))))
query("D27_region_mean_color", "SELECT box_id, r(avg(b)) AS b, r(avg(g)) AS g, r(avg(r)) AS r FROM fx_pixel p JOIN fx_box q ON p.frame_idx = q.frame_idx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY box_id", "fx_pixel", "fx_box")(teams.region_mean_color)
for _region, _low, _high in (("upper", "y1", "y1 + trunc((y2 - y1) * 0.4)"), ("center", "y1 + trunc((y2 - y1) * 0.3)", "y1 + trunc((y2 - y1) * 0.7)")):
    query(f"D27_region_mean_color_{_region}", f"SELECT box_id, r(avg(b)) AS b, r(avg(g)) AS g, r(avg(r)) AS r FROM fx_pixel p JOIN fx_box q ON p.frame_idx = q.frame_idx AND x >= x1 AND x < least(x2, 20) AND y >= {_low} AND y < least({_high}, y2, 20) GROUP BY box_id", "fx_pixel", "fx_box")(
        lambda p, q, region=_region: teams.region_mean_color(p, q, region=region, size=(20, 20)))
query("K1_own_color_extraction", "SELECT box_id, i(max(b)) AS b, i(min(g)) AS g, r(median(r)) AS r FROM fx_pixel p JOIN fx_box q ON p.frame_idx = q.frame_idx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY box_id", "fx_pixel", "fx_box")(
    lambda p, q: teams.region_mean_color(p, q, lambda b, g, r: {"b": F.max(b), "g": F.min(g), "r": F.median(r)}))
query("K1_python_color_extraction", "SELECT box_id, r(median(b)) AS b, r(median(g)) AS g, r(median(r)) AS r FROM fx_pixel p JOIN fx_box q ON p.frame_idx = q.frame_idx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY box_id", "fx_pixel", "fx_box")(
    lambda p, q: teams.region_mean_color(p, q, _python_medians, most=4096))

# ---- windows and events ------------------------------------------------------------------------------------------
PATH = "p AS (SELECT *, row_number() OVER o AS row, count(*) OVER (PARTITION BY match_id) AS n FROM fx_ball WINDOW o AS (PARTITION BY match_id ORDER BY frame_idx, track_id))"
VEL = f"""{PATH}, d AS (SELECT *, coalesce(lead(frame_idx) OVER o, frame_idx) - coalesce(lag(frame_idx) OVER o, frame_idx) AS dt, coalesce(lead(cx) OVER o, cx) - coalesce(lag(cx) OVER o, cx) AS dx, coalesce(lead(cy) OVER o, cy) - coalesce(lag(cy) OVER o, cy) AS dy
FROM p WINDOW o AS (PARTITION BY match_id ORDER BY frame_idx, track_id)), v AS (SELECT * EXCLUDE (dt, dx, dy), CASE WHEN n < 2 THEN NULL WHEN dt > 0 THEN dx / dt ELSE 0.0 END AS vx, CASE WHEN n < 2 THEN NULL WHEN dt > 0 THEN dy / dt ELSE 0.0 END AS vy FROM d)"""
SMOOTH = f"""{VEL}, w AS (SELECT * REPLACE (CASE WHEN n < 3 THEN vx ELSE avg(vx) OVER o END AS vx, CASE WHEN n < 3 THEN vy ELSE avg(vy) OVER o END AS vy) FROM v WINDOW o AS (PARTITION BY match_id ORDER BY frame_idx, track_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
q AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM w)"""
SEG = f"{SMOOTH}, f AS (SELECT *, row - row_number() OVER (PARTITION BY match_id ORDER BY row) AS island FROM q WHERE speed >= 15), g AS (SELECT match_id, min(row) AS first_row, max(row) AS last_row, count(*) AS n_points, avg(speed) AS avg_speed, stddev_pop(atan2(vy, vx)) AS angle_std FROM f GROUP BY match_id, island)"
SHOTS = f"""{SEG}, s0 AS (SELECT g.*, a.frame_idx, a.ts_s, a.cx AS x, a.cy AS y, e.cy - a.cy AS dy FROM g JOIN q a ON a.match_id = g.match_id AND a.row = first_row JOIN q e ON e.match_id = g.match_id AND e.row = least(last_row + 5, a.n) WHERE n_points >= 2),
shots AS (SELECT match_id, frame_idx, ts_s, x, y, (least(1.0, avg_speed / 30) + greatest(0.0, 1 - angle_std / pi())) / 2 AS confidence, avg_speed AS speed, CASE WHEN dy < -5 THEN 'top' ELSE 'bottom' END AS target_goal, n_points AS duration_frames FROM s0 WHERE abs(dy) > 5)"""
GOALS = f"""{SHOTS}, z AS (SELECT *, {REGION_SQL} AS goal_region FROM q), y_ AS (SELECT *, row - 1 + 10 >= n OR sum((goal_region IS NOT NULL OR cy < 1080 * 0.2 OR cy > 1080 * 0.8)::INT) OVER (PARTITION BY match_id ORDER BY row ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 5 AS stays FROM z),
c0 AS (SELECT y_.match_id, y_.frame_idx, y_.ts_s, cx AS x, cy AS y, goal_region, arg_min(struct_pack(f := s.frame_idx, t := s.ts_s, c := s.confidence, g := s.target_goal), s.frame_idx) AS s FROM y_ JOIN shots s ON s.match_id = y_.match_id AND (y_.frame_idx - s.frame_idx) / 25.0 BETWEEN 0 AND 3
WHERE goal_region IS NOT NULL AND stays GROUP BY ALL), c1 AS (SELECT *, CASE WHEN s.g = goal_region THEN least(1.0, least(1.0, s.c * 1.2) * 1.1) ELSE least(1.0, s.c * 1.2) END AS confidence FROM c0),
cand AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts_s, frame_idx) AS k FROM c1 WHERE confidence >= 0.6)"""
DEDUP = """anchors AS (SELECT match_id, min(ts_s) AS anchor FROM cand GROUP BY match_id
UNION ALL SELECT a.match_id, (SELECT min(c.ts_s) FROM cand c WHERE c.match_id = a.match_id AND c.ts_s - a.anchor > 5) FROM anchors a WHERE EXISTS (SELECT 1 FROM cand c WHERE c.match_id = a.match_id AND c.ts_s - a.anchor > 5)),
best AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.match_id, anchor ORDER BY confidence DESC, k) AS rn FROM cand JOIN anchors a ON a.match_id = cand.match_id AND cand.ts_s >= anchor AND cand.ts_s - anchor <= 5)"""
query("E1_ball_path", "SELECT match_id, i(row_number() OVER (PARTITION BY match_id ORDER BY frame_idx, track_id)) AS row, i(count(*) OVER (PARTITION BY match_id)) AS n, track_id, frame_idx, r(ts_s) AS ts_s, r((x1 + x2) / 2) AS cx, r((y1 + y2) / 2) AS cy, r(confidence) AS confidence FROM fx_trk WHERE object_type = 'ball'", "fx_trk")(
    lambda t: path.ball_path(t).select("match_id", "row", "n", "track_id", "frame_idx", "ts_s", "cx", "cy", "confidence"))
query("E2_velocity", f"WITH {VEL} SELECT match_id, frame_idx, r(vx) AS vx, r(vy) AS vy, r(sqrt(vx * vx + vy * vy)) AS speed FROM v", "fx_ball")(lambda b: _ball(b).select("match_id", "frame_idx", "vx", "vy", "speed"))
query("E3_smooth", f"WITH {SMOOTH} SELECT match_id, frame_idx, r(vx) AS vx, r(vy) AS vy, r(speed) AS speed FROM q", "fx_ball")(lambda b: _smooth(b).select("match_id", "frame_idx", "vx", "vy", "speed"))
query("E4_fast_segments", f"WITH {SEG} SELECT match_id, i(first_row) AS first_row, i(last_row) AS last_row, i(n_points) AS n_points, r(avg_speed) AS avg_speed, r(angle_std) AS angle_std FROM g WHERE n_points >= 3", "fx_ball")(lambda b: path.fast_segments(_smooth(b), 15.0))
query("E5_direction_changes", f"""WITH {VEL}, a AS (SELECT *, lead(vx) OVER o AS nx, lead(vy) OVER o AS ny FROM v WINDOW o AS (PARTITION BY match_id ORDER BY row)),
c AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (vx * nx + vy * ny) / (sqrt(vx * vx + vy * vy) * sqrt(nx * nx + ny * ny)))))) AS angle FROM a WHERE sqrt(vx * vx + vy * vy) >= 1e-6 AND sqrt(nx * nx + ny * ny) >= 1e-6)
SELECT match_id, frame_idx, r(round(angle, 4)) AS angle FROM c WHERE row > 1 AND row < n AND angle >= 45""", "fx_ball")(
    lambda b: path.direction_changes(_ball(b)).select("match_id", "frame_idx", F.round("angle", 4).alias("angle")))
query("E6_stays_in_goal", f"WITH {GOALS} SELECT match_id, frame_idx, stays FROM y_", "fx_ball", "fx_match")(
    lambda b, m: path.stays_in_goal(boxes.with_match(path.numbered(b), m).withColumn("goal_region", G.goal_region_of(F.col("cx"), F.col("cy"), F.col("width"), F.col("height")))).select("match_id", "frame_idx", "stays"))
query("E7_score_timeline", "SELECT match_id, r(ts_s) AS ts_s, frame_idx, i(count(*) FILTER (region = 'top') OVER o) AS team_a, i(count(*) FILTER (region = 'bottom') OVER o) AS team_b, r(confidence) AS confidence, region AS goal_region FROM fx_evt WHERE event_type = 'goal' WINDOW o AS (PARTITION BY match_id ORDER BY ts_s, frame_idx)", "fx_evt")(
    lambda e: events.score_timeline(e.filter("event_type = 'goal'").withColumnRenamed("region", "goal_region")))
query("E8_trails", """WITH t AS (SELECT *, i(least(30, row_number() OVER o)) AS n_trail, sum((x1 + x2) / 2) OVER w AS sx, sum((y1 + y2) / 2) OVER w AS sy FROM fx_trk WHERE frame_idx % 7 NOT IN (2, 5)
WINDOW o AS (PARTITION BY match_id, track_id ORDER BY frame_idx), w AS (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT match_id, track_id, frame_idx, n_trail, r(sx) AS sum_cx, r(sy) AS sum_cy, array_to_string(list_transform(range(1, n_trail), lambda i: greatest(1, CAST(floor(3.0 * i / n_trail) AS BIGINT))), ',') AS widths FROM t WHERE n_trail >= 2""", "fx_trk")(
    lambda t: display.trails(t.withColumn("x1", F.when(F.col("frame_idx") % 7 == 2, float("nan")).when(F.col("frame_idx") % 7 == 5, float("inf")).otherwise(F.col("x1")))).select(
        "match_id", "track_id", "frame_idx", "n_trail", *[F.aggregate("trail", F.lit(0.0), _adder(c)).alias(f"sum_{c}") for c in ("cx", "cy")], F.array_join("thickness", ",").alias("widths")))
query("E9_ticks", "SELECT match_id, frame_idx, i(slot) AS slot, i(dense_rank() OVER (PARTITION BY match_id ORDER BY frame_idx)) AS tick FROM fx_det", "fx_det")(lambda d: tracking.ticked(d).select("match_id", "frame_idx", "slot", "tick"))


def _shots(b):
    return events.shots(_smooth(b))


def _goals(b, m):
    p = _smooth(b)
    return events.goals(p, events.shots(p), m)


SHOT_COLS = "match_id, frame_idx, r(ts_s) AS ts_s, r(x) AS x, r(y) AS y, r(confidence) AS confidence"
query("I1_shots", f"WITH {SHOTS} SELECT {SHOT_COLS}, r(speed) AS speed, target_goal, i(duration_frames) AS duration_frames FROM shots", "fx_ball")(_shots)
query("I2_goals", f"WITH RECURSIVE {GOALS}, {DEDUP} SELECT {SHOT_COLS}, goal_region, s.f AS shot_frame, r(s.t) AS shot_timestamp FROM best WHERE rn = 1", "fx_ball", "fx_match")(_goals)
query("I4_dedup_events", f"WITH RECURSIVE cand AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts_s, frame_idx) AS k FROM fx_evt WHERE event_type = 'goal'), {DEDUP} SELECT match_id, frame_idx, r(confidence) AS confidence, region FROM best WHERE rn = 1", "fx_evt")(
    lambda e: events.dedup_events(e.filter("event_type = 'goal'").select("match_id", "frame_idx", "ts_s", "confidence", "region")).select("match_id", "frame_idx", "confidence", "region"))
query("D28_final_score", f"WITH RECURSIVE {GOALS}, {DEDUP} SELECT match_id, i(count(*)) AS goals, i(count(*) FILTER (goal_region = 'top')) AS team_a, i(count(*) FILTER (goal_region = 'bottom')) AS team_b FROM best WHERE rn = 1 GROUP BY match_id", "fx_ball", "fx_match")(lambda b, m: events.final_score(_goals(b, m)))
ALL_SQL = f"WITH RECURSIVE {GOALS}, {DEDUP} SELECT 'shot' AS event_type, match_id, frame_idx, r(ts_s) AS ts_s, r(confidence) AS confidence, target_goal, NULL AS goal_region FROM shots UNION ALL SELECT 'goal', match_id, frame_idx, r(ts_s), r(confidence), NULL, goal_region FROM best WHERE rn = 1"


def _all(b, m):
    p = _smooth(b)
    s = events.shots(p)
    out = events.in_time_order(events.all_events(s, events.goals(p, s, m)))
    return out.select("event_type", "match_id", "frame_idx", "ts_s", "confidence", "target_goal", "goal_region")


query("F3_all_events", ALL_SQL, "fx_ball", "fx_match")(_all)
query("G1_union", ALL_SQL, "fx_ball", "fx_match")(lambda b, m: events.all_events(_shots(b), _goals(b, m)).select("event_type", "match_id", "frame_idx", "ts_s", "confidence", "target_goal", "goal_region"))
query("F1_top_shots", "SELECT match_id, frame_idx, r(confidence) AS confidence, i(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY confidence DESC, frame_idx) AS rank FROM fx_evt WHERE event_type = 'shot') WHERE rank <= 10", "fx_evt")(
    lambda e: reports.top_shots(e).select("match_id", "frame_idx", "confidence", "rank"))
query("F2_longest_tracks", "SELECT match_id, track_id, team_name, i(length) AS length, i(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY length DESC, track_id, team_name) AS rank FROM (SELECT match_id, track_id, team_name, count(*) AS length FROM fx_trk GROUP BY ALL)) WHERE rank <= 20", "fx_trk")(reports.longest_tracks)
query("F4_event_timeline", "SELECT match_id, event_type, frame_idx, r(ts_s) AS ts_s, r(confidence) AS confidence FROM fx_evt", "fx_evt")(reports.event_timeline)
query("F5_sample_tracks", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY md5(concat_ws(':', track_id, frame_idx, 42)), track_id, frame_idx) AS rank, count(*) OVER (PARTITION BY match_id) AS total FROM fx_trk)
SELECT match_id, frame_idx, track_id, total FROM k WHERE rank <= 1000""", "fx_trk")(lambda t: reports.sample_tracks(t).select("match_id", "track_id", "frame_idx", "total"))

# ---- scalar functions --------------------------------------------------------------------------------------------
MOVED_SQL = "greatest(0.0, least(x2, x2 + 10) - greatest(x1, x1 + 10)) * greatest(0.0, least(y2, y2 - slot * 8) - greatest(y1, y1 - slot * 8))"
query("H1_iou", f"SELECT match_id, frame_idx, i(slot) AS slot, r(CASE WHEN {MOVED_SQL} > 0 THEN {MOVED_SQL} / (2 * (x2 - x1) * (y2 - y1) - {MOVED_SQL}) ELSE 0.0 END) AS iou FROM fx_det", "fx_det")(
    lambda d: d.select("match_id", "frame_idx", "slot", G.iou(tuple(F.col(c) for c in BOX), (F.col("x1") + 10, F.col("y1") - F.col("slot") * 8, F.col("x2") + 10, F.col("y2") - F.col("slot") * 8)).alias("iou")))
query("H2_box_state", "SELECT match_id, frame_idx, i(slot) AS slot, r((x1 + x2) / 2) AS xc, r((y1 + y2) / 2) AS yc, r((x2 - x1) * (y2 - y1)) AS area, r((x2 - x1) / (y2 - y1)) AS aspect FROM fx_det", "fx_det")(
    lambda d: d.select("match_id", "frame_idx", "slot", G.box_state(*[F.col(c) for c in BOX]).alias("s")).select("match_id", "frame_idx", "slot", "s.*"))
query("H3_state_box", "WITH t AS (SELECT *, (x1 + x2) / 2 AS xc, sqrt(greatest(0.0, 900 - slot * 60.0) / greatest(0.1, slot / 10.0)) AS h, greatest(0.1, slot / 10.0) * sqrt(greatest(0.0, 900 - slot * 60.0) / greatest(0.1, slot / 10.0)) AS w FROM fx_det) SELECT match_id, frame_idx, i(slot) AS slot, r(xc - w / 2) AS x1, r(y1 - h / 2) AS y1, r(xc + w / 2) AS x2, r(y1 + h / 2) AS y2 FROM t", "fx_det")(
    lambda d: d.select("match_id", "frame_idx", "slot", G.state_box((F.col("x1") + F.col("x2")) / 2, F.col("y1"), 900 - F.col("slot") * 60.0, F.col("slot") / 10.0).alias("s")).select("match_id", "frame_idx", "slot", "s.*"))
query("H4_bgr_to_hsv", f"WITH m AS (SELECT *, b AS b_, g AS g_, r AS r_, greatest(b, g, r) AS mx, least(b, g, r) AS mn FROM fx_pixel), {HSV_SQL} SELECT frame_idx, x, y, r(h) AS h, r(s) AS s, r(v) AS v FROM h", "fx_pixel")(
    lambda p: p.select("frame_idx", "x", "y", C.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).select("frame_idx", "x", "y", "c.*"))
query("H5_hsv_to_bgr", """WITH t AS (SELECT frame_idx, x, y, b::DOUBLE % 180 AS h, (g::DOUBLE) / 255 AS s, r::DOUBLE AS v FROM fx_pixel), u AS (SELECT *, floor(h / 30) % 6 AS k, h / 30 - floor(h / 30) AS f FROM t), w AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t_ FROM u)
SELECT frame_idx, x, y, r(floor(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t_ WHEN 3 THEN v WHEN 4 THEN v ELSE q END + 0.5)) AS b, r(floor(CASE k WHEN 0 THEN t_ WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END + 0.5)) AS g, r(floor(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t_ ELSE v END + 0.5)) AS r FROM w""", "fx_pixel")(
    lambda p: p.select("frame_idx", "x", "y", C.hsv_to_bgr(F.col("b") % 180, F.col("g"), F.col("r")).alias("c")).select("frame_idx", "x", "y", "c.*"))
query("H6_color_distance", "SELECT frame_idx, x, y, r(sqrt(pow(b - 210.0, 2) + pow(g - 45.0, 2) + pow(r - 50.0, 2))) AS bgr, r(sqrt(pow(2 * least(abs(b % 180 - 170.0), 180 - abs(b % 180 - 170.0)), 2) + pow(g - 45.0, 2) + pow(r - 50.0, 2))) AS hsv FROM fx_pixel", "fx_pixel")(
    lambda p: p.select("frame_idx", "x", "y", C.bgr_distance((F.col("b"), F.col("g"), F.col("r")), (F.lit(210.0), F.lit(45.0), F.lit(50.0))).alias("bgr"), C.hsv_distance((F.col("b") % 180, F.col("g"), F.col("r")), (F.lit(170.0), F.lit(45.0), F.lit(50.0))).alias("hsv")))
query("H7_similar", "SELECT frame_idx, x, y, sqrt(pow(b - 110.0, 2) + pow(g - 145.0, 2) + pow(r - 150.0, 2)) < 50 AS similar FROM fx_pixel", "fx_pixel")(
    lambda p: p.select("frame_idx", "x", "y", C.similar(C.bgr_distance((F.col("b"), F.col("g"), F.col("r")), (F.lit(110.0), F.lit(145.0), F.lit(150.0)))).alias("similar")))
query("H8_hex_to_bgr", "SELECT frame_idx, x, y, b, g, r FROM fx_pixel", "fx_pixel")(
    lambda p: p.select("frame_idx", "x", "y", C.hex_to_bgr(F.concat(F.when(F.col("x") % 2 == 0, "#").otherwise(""), F.format_string("%02X%02X%02X", "r", "g", "b"))).alias("c")).select("frame_idx", "x", "y", "c.*"))
query("H9_clock", "SELECT match_id, frame_idx, CAST(floor(ts_s / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(ts_s % 60) AS BIGINT) AS VARCHAR), 2, '0') AS clock FROM fx_evt", "fx_evt")(lambda e: e.select("match_id", "frame_idx", G.clock(F.col("ts_s")).alias("clock")))

# ---- multi-step --------------------------------------------------------------------------------------------------
query("I3_track", None, "fx_det")(lambda d: tracking.track(d))
query("J1_track_stream", None, "fx_det")(lambda d: live.replay(d))
query("I5_assign_teams", None, "fx_det")(lambda d: teams.assign_teams(boxes.players(_present(d)).withColumn("track_id", F.col("slot"))))
query("I6_name_teams", "SELECT DISTINCT match_id, i(slot % 6) AS team_id, CASE WHEN slot % 6 < 4 THEN 'team_' || chr(CAST(65 + slot % 6 AS INTEGER)) ELSE 'team_' || (slot % 6) END AS team_name FROM fx_det", "fx_det")(
    lambda d: teams.name_teams(d.select("match_id", (F.col("slot") % 6).alias("team_id")).distinct()))
query("I7_dominant_color", None, "fx_pixel", "fx_box")(teams.dominant_color)
query("X1_detections_to_shots", None, "fx_det")(lambda d: _end_to_end(d))


def _end_to_end(d):
    p = path.smooth(path.velocity(path.ball_path(tracking.track(d, kinds=("ball",)))))
    return events.shots(p, speed=2.0)


# ---- files -------------------------------------------------------------------------------------------------------
def _file(name: str, sql: str | None, inputs: tuple, write, read) -> None:
    """A query that writes a fixture to a new folder of the session's shared one and reads it back."""

    def run(spark, sf_dir):
        at = io.scratch(spark, name)
        write(at, *[fx(spark, sf_dir, i) for i in inputs])
        return rounded(read(spark, at))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = oracle(sql)


def _csv(spark, at, schema):
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(at)


def _as_detections(d):
    return io.packed(d.select("match_id", "frame_idx", "ts_s", "slot", "object_type", F.col("class_id").cast("int"), *BOX, "confidence"))


DET_ALL = ("match_id", "frame_idx", "ts_s", "slot", "object_type", "class_id", *BOX, "confidence", "width", "height", "area")
DET_SQL = """SELECT match_id, frame_idx, r(ts_s) AS ts_s, i(slot) AS slot, object_type, i(class_id) AS class_id, r(x1) AS x1, r(y1) AS y1, r(x2) AS x2, r(y2) AS y2, r(confidence) AS confidence,
r(x2 - x1) AS width, r(y2 - y1) AS height, r((x2 - x1) * (y2 - y1)) AS area FROM fx_det"""
DET_FILE_SQL = DET_SQL.replace(" FROM fx_det", ", r((x1 + x2) / 2) AS center_0, r((y1 + y2) / 2) AS center_1 FROM fx_det")


def _centers(d):
    """Rows as the file has them, with the parts of the center beside what the reader returns."""
    return io.unpacked(d.withColumns({"center_0": F.get("center", 0), "center_1": F.get("center", 1)})).select(*DET_ALL, "center_0", "center_1")


_file("A1_read_detections", DET_SQL, ("fx_det",), lambda at, d: io.write_table(_as_detections(d), at), lambda s, at: io.read_detections(s, at).select(*DET_ALL))
_file("A2_detections_json", DET_FILE_SQL, ("fx_det",), lambda at, d: io.write_table(_as_detections(d), at, "json", ("match_id",)), lambda s, at: _centers(io.read_table(s, at, io.DETECTIONS, "json")))
DET_CSV = "match_id long, frame_idx long, timestamp double, det_idx long, object_type string, class_id int, confidence double, width double, height double, area double, bbox_0 double, bbox_1 double, bbox_2 double, bbox_3 double, center_0 double, center_1 double"
DET_CSV_SQL = DET_FILE_SQL.replace(" AS ts_s", " AS timestamp").replace(" AS slot", " AS det_idx").replace(" AS x1", " AS bbox_0").replace(" AS y1", " AS bbox_1").replace(" AS x2", " AS bbox_2").replace(" AS y2", " AS bbox_3")
_file("A3_detections_csv", DET_CSV_SQL, ("fx_det",), lambda at, d: io.write_table(_as_detections(d), at, "csv"), lambda s, at: _csv(s, at, DET_CSV))
TRK_SQL = "SELECT match_id, track_id, frame_idx, r(ts_s) AS ts_s, object_type, r(x1) AS x1, i(hits) AS hits, i(team_id) AS team_id, team_name FROM fx_trk"
TRK_COLS = ("match_id", "track_id", "frame_idx", "ts_s", "object_type", "x1", "hits", "team_id", "team_name")
_file("A4_read_tracks", TRK_SQL, ("fx_trk",), lambda at, t: io.write_table(io.packed(t.withColumn("team_id", F.col("team_id").cast("int"))), at), lambda s, at: io.read_tracks(s, at).select(*TRK_COLS))
_file("A5_rewrite_tracks", TRK_SQL, ("fx_trk",),
      lambda at, t: io.write_table(io.packed(teams.label_tracks(t, t.select("match_id", "track_id", "team_id").distinct(), t.select("match_id", "team_id", "team_name").distinct()).withColumn("team_id", F.col("team_id").cast("int"))), at),
      lambda s, at: io.read_tracks(s, at).select(*TRK_COLS))
EVT_SQL = "SELECT match_id, event_type, frame_idx, r(ts_s) AS ts_s, r(confidence) AS confidence, CASE WHEN event_type = 'shot' THEN region END AS target_goal, CASE WHEN event_type = 'goal' THEN region END AS goal_region, r(speed) AS speed FROM fx_evt"


def _as_events(e):
    return e.withColumns({"x": F.lit(1.0), "y": F.lit(2.0), "target_goal": F.when(F.col("event_type") == "shot", F.col("region")), "goal_region": F.when(F.col("event_type") == "goal", F.col("region"))})


_file("A6_events_json", EVT_SQL, ("fx_evt",), lambda at, e: io.write_events(_as_events(e), at), lambda s, at: io.read_events(s, at).select("match_id", "event_type", "frame_idx", "ts_s", "confidence", "target_goal", "goal_region", "speed"))
_file("A7_score_document", "SELECT match_id, r(ts_s) AS ts_s, frame_idx, i(count(*) FILTER (region = 'top') OVER o) AS team_a, i(count(*) FILTER (region = 'bottom') OVER o) AS team_b, r(confidence) AS confidence, region AS goal_region FROM fx_evt WHERE event_type = 'goal' WINDOW o AS (PARTITION BY match_id ORDER BY ts_s, frame_idx)", ("fx_evt",),
      lambda at, e: io.write_score(events.score_timeline(e.filter("event_type = 'goal'").withColumnRenamed("region", "goal_region")), at), io.read_score)
_file("A8_team_document", "SELECT match_id, track_id, i(team_id) AS team_id, team_name, r(team_id * 10.0) AS b, r(2.0) AS g, r(3.0) AS r FROM (SELECT DISTINCT match_id, track_id, team_id, team_name FROM fx_trk WHERE team_id >= 0)", ("fx_trk",),
      lambda at, t: io.write_teams(t.filter("team_id >= 0").select("match_id", "team_id", "team_name", (F.col("team_id") * 10.0).alias("b"), F.lit(2.0).alias("g"), F.lit(3.0).alias("r")).distinct(), t.filter("team_id >= 0").select("match_id", "team_id", "track_id").distinct(), at),
      lambda s, at: (lambda named, who: who.join(named.hint("merge"), ["match_id", "team_id"]).select("match_id", "track_id", "team_id", "team_name", "b", "g", "r"))(*io.read_teams(s, at)))
_file("A9_read_matches", "SELECT match_id, r(fps) AS fps, i(total_frames) AS total_frames, i(width) AS width, i(height) AS height, r(duration) AS duration, 'avc1' AS codec FROM fx_match", ("fx_match",),
      lambda at, m: io.write_documents(m.withColumn("codec", F.lit("avc1")), at), io.read_matches)
_file("A10_read_manifests", """SELECT match_id, '1.0' AS schema_version, 'v' || match_id || '.mp4' AS video_path, 'runs/' || match_id AS output_dir, '2024-01-01T10:00:00' AS start_time, '2024-01-01T11:00:00' AS end_time,
'{"sampling":{"n":' || match_id || '}}' AS config, 'detect,track' AS stages FROM fx_match""", ("fx_match",),
      lambda at, m: io.write_documents(_manifests(m), at), lambda s, at: io.read_manifests(s, at).withColumn("config", F.to_json(F.from_json("config", "sampling struct<n: long>"))).withColumn("stages", F.array_join("stages", ",")))


def _manifests(m):
    return m.select(
        "match_id", F.lit("1.0").alias("schema_version"), F.format_string("v%d.mp4", "match_id").alias("video_path"), F.format_string("runs/%d", "match_id").alias("output_dir"), F.lit("2024-01-01T10:00:00").alias("start_time"),
        F.lit("2024-01-01T11:00:00").alias("end_time"), F.struct(F.struct(F.col("match_id").alias("n")).alias("sampling")).alias("config"), F.array(F.lit("detect"), F.lit("track")).alias("stages"))


# ---- the exports of the report scripts, each with all its columns
for _name, _where, _pick in (("balls", "object_type = 'ball'", boxes.balls), ("first_minute", "ts_s <= 60", boxes.time_slice)):
    # Times run nine times as fast, so that the first minute ends before the last frame on every scale.
    _file(f"A11_export_{_name}_csv", DET_CSV_SQL.replace("fx_det", f"(SELECT * REPLACE (ts_s * 9 AS ts_s) FROM fx_det) WHERE {_where}"), ("fx_det",),
          lambda at, d, pick=_pick: io.export_csv(_as_detections(pick(d.withColumn("ts_s", F.col("ts_s") * 9))), at), lambda s, at: _csv(s, at, DET_CSV))
_file("A11_export_frame_summary_csv", "SELECT match_id, frame_idx, count(*) FILTER (object_type = 'player') || ' players, ' || count(*) FILTER (object_type = 'ball') || ' balls' AS object_type, r(min(ts_s)) AS timestamp, r(avg(confidence)) AS confidence FROM fx_det GROUP BY match_id, frame_idx", ("fx_det",),
      lambda at, d: io.export_csv(reports.frame_summary(d), at), lambda s, at: _csv(s, at, "match_id long, frame_idx long, object_type string, timestamp double, confidence double"))
TRK_CSV = "match_id long, track_id long, frame_idx long, timestamp double, object_type string, confidence double, age long, hits long, time_since_update long, team_id int, team_name string, bbox_0 double, bbox_1 double, bbox_2 double, bbox_3 double"
for _name, _where, _pick in (("tracks", "true", lambda t: t), ("ball_tracks", "object_type = 'ball'", boxes.balls)):
    _file(f"A12_export_{_name}_csv", f"SELECT match_id, track_id, frame_idx, r(ts_s) AS timestamp, object_type, r(confidence) AS confidence, i(age) AS age, i(hits) AS hits, i(time_since_update) AS time_since_update, i(team_id) AS team_id, team_name, r(x1) AS bbox_0, r(y1) AS bbox_1, r(x2) AS bbox_2, r(y2) AS bbox_3 FROM fx_trk WHERE {_where}", ("fx_trk",),
          lambda at, t, pick=_pick: io.export_csv(io.packed(pick(t)), at), lambda s, at: _csv(s, at, TRK_CSV))
_file("A12_export_track_summary_csv", """SELECT match_id, track_id, any_value(object_type) AS object_type_first, min(frame_idx) AS frame_idx_min, max(frame_idx) AS frame_idx_max, i(count(*)) AS frame_idx_count, r(min(ts_s)) AS timestamp_min, r(max(ts_s)) AS timestamp_max,
r(avg(confidence)) AS confidence_mean, i(max(hits)) AS hits_max, i(max(age)) AS age_max FROM fx_trk GROUP BY match_id, track_id""", ("fx_trk",), lambda at, t: io.export_csv(reports.track_summary(t), at),
      lambda s, at: _csv(s, at, "match_id long, track_id long, object_type_first string, frame_idx_min long, frame_idx_max long, frame_idx_count long, timestamp_min double, timestamp_max double, confidence_mean double, hits_max long, age_max long"))
_file("A12_export_trajectories_csv", "SELECT match_id, track_id, frame_idx, r(ts_s) AS timestamp, r((x1 + x2) / 2) AS center_x, r((y1 + y2) / 2) AS center_y FROM fx_trk WHERE object_type = 'player'", ("fx_trk",),
      lambda at, t: io.export_csv(boxes.player_centers(t).select("match_id", "track_id", "frame_idx", "ts_s", "cx", "cy"), at),
      lambda s, at: _csv(s, at, "match_id long, track_id long, frame_idx long, timestamp double, center_x double, center_y double"))
_file("A13_export_by_team", "SELECT match_id, track_id, frame_idx, team_name, r(ts_s) AS timestamp, i(team_id) AS team_id, r(x1) AS bbox_0, r(y1) AS bbox_1, r(x2) AS bbox_2, r(y2) AS bbox_3 FROM fx_trk WHERE team_name <> 'unknown'", ("fx_trk",), lambda at, t: io.export_by_team(io.packed(t), at),
      lambda s, at: s.read.option("header", True).csv(at).select(*[F.col(c).cast("long").alias(c) for c in ("match_id", "track_id", "frame_idx", "team_id")], "team_name", *[F.col(c).cast("double").alias(c) for c in ("timestamp", "bbox_0", "bbox_1", "bbox_2", "bbox_3")]))
_file("A13_export_team_summary", """SELECT match_id, i(team_id) AS team_id, team_name, i(count(DISTINCT track_id)) AS track_id_nunique, min(frame_idx) AS frame_idx_min, max(frame_idx) AS frame_idx_max, i(count(*)) AS frame_idx_count,
r(avg(confidence)) AS confidence_mean FROM fx_trk GROUP BY match_id, team_id, team_name""", ("fx_trk",), lambda at, t: io.export_csv(reports.team_summary(t), at),
      lambda s, at: _csv(s, at, "match_id long, team_id int, team_name string, track_id_nunique long, frame_idx_min long, frame_idx_max long, frame_idx_count long, confidence_mean double"))
#: As the files of events have them, of shots and goals as `all_events` gives them.
EVT_CSV = "match_id long, event_type string, frame_idx long, timestamp double, confidence double, speed double, target_goal string, duration_frames long, goal_region string, shot_frame long, shot_timestamp double, location_0 double, location_1 double"
EVT_FILE_SQL = """SELECT match_id, event_type, frame_idx, r(ts_s) AS timestamp, r(confidence) AS confidence, r(1.0) AS location_0, r(2.0) AS location_1, r(speed) AS speed, CASE WHEN event_type = 'shot' THEN region END AS target_goal,
CAST(NULL AS BIGINT) AS duration_frames, CASE WHEN event_type = 'goal' THEN region END AS goal_region, CAST(NULL AS BIGINT) AS shot_frame, r(CAST(NULL AS DOUBLE)) AS shot_timestamp FROM fx_evt"""
for _name, _where in (("shots", "event_type = 'shot'"), ("goals", "event_type = 'goal'"), ("events", "true")):
    _file(f"A14_export_{_name}_csv", f"{EVT_FILE_SQL} WHERE {_where}", ("fx_evt",),
          lambda at, e, kind=_name[:-1]: io.export_csv(io.packed_events(_as_events(e if kind == "event" else boxes.events_of(e, kind))), at), lambda s, at: _csv(s, at, EVT_CSV))
_file("A14_export_event_timeline_csv", "SELECT match_id, event_type, r(ts_s) AS timestamp, r(confidence) AS confidence, frame_idx FROM fx_evt", ("fx_evt",), lambda at, e: io.export_csv(reports.event_timeline(e), at),
      lambda s, at: _csv(s, at, "match_id long, event_type string, timestamp double, confidence double, frame_idx long"))


# ---- runs
def _write_runs(at, e, m):
    """Runs a and b: a has events, metadata, a manifest and a timeline, b has metadata alone. Spark's part files stand in folders of the files' names."""
    io.write_events(_as_events(e), f"{at}/a/events.jsonl")
    one = m.agg(F.max("fps").alias("fps"), F.max("total_frames").alias("total_frames"), F.max("width").alias("width"), F.max("height").alias("height"), F.max("duration").alias("duration"), F.lit("avc1").alias("codec"))
    as_text = lambda d: d.select(F.to_json(F.struct("*"), {"pretty": "true"}))
    for run in "ab":
        as_text(one).write.text(f"{at}/{run}/video_metadata.json")
    as_text(_manifests(m.agg(F.min("match_id").alias("match_id"))).drop("match_id")).write.text(f"{at}/a/run_manifest.json")
    as_text(m.agg(F.count(F.lit(1)).alias("goals"))).write.text(f"{at}/a/score_timeline.json")


_RUN_META_SQL = "(SELECT r(max(fps)) AS fps, i(max(width)) AS width, i(max(height)) AS height, r(max(duration)) AS duration FROM fx_match)"
_file("A15_list_runs", f"""SELECT run, run = 'a' AS has_events, run = 'a' AS has_timeline, run = 'a' AS has_manifest, fps, duration, width, height, i(CASE WHEN run = 'a' THEN s ELSE 0 END) AS n_shot, i(CASE WHEN run = 'a' THEN g ELSE 0 END) AS n_goal, i(0) AS n_other
FROM (VALUES ('a'), ('b')) v(run), {_RUN_META_SQL} m, (SELECT count(*) FILTER (event_type = 'shot') AS s, count(*) FILTER (event_type = 'goal') AS g FROM fx_evt) e""", ("fx_evt", "fx_match"), _write_runs, runs.list_runs)
_file("A16_run_metadata", f"""SELECT run, fps, width, duration, CASE WHEN run = 'a' THEN 'v' || (SELECT min(match_id) FROM fx_match) || '.mp4' END AS video_path, CASE WHEN run = 'a' THEN '1.0' END AS schema_version, false AS has_teams
FROM (VALUES ('a'), ('b')) v(run), {_RUN_META_SQL} m""", ("fx_evt", "fx_match"), _write_runs,
      lambda s, at: runs.run_metadata(s, at, "a").unionByName(runs.run_metadata(s, at, "b")).select("run", "video_metadata.fps", "video_metadata.width", "video_metadata.duration", "manifest.video_path", "manifest.schema_version", F.col("teams").isNotNull().alias("has_teams")))
_file("A17_run_events", "SELECT match_id, event_type, frame_idx, i(count(*) OVER ()) AS n_events FROM fx_evt", ("fx_evt", "fx_match"), _write_runs, lambda s, at: runs.run_events(s, at, "a").select("match_id", "event_type", "frame_idx", "n_events"))
