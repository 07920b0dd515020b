"""Shots, goals, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import path as P
from trackframe.operators import slices
from trackframe.sources import io

#: Events of a match up to which its windows are folded in one row; matches with more are followed by pointers.
FOLD = 1000


def shots(path: DataFrame, speed: float = 15.0, min_points: int = 2) -> DataFrame:
    """match_id, frame_idx, ts_s, x, y, confidence, speed, target_goal, duration_frames of a smoothed path's fast segments.

    The ball has to move by over 5 pixels in y up to the fifth point after the segment; its speed and straightness make the confidence.
    """
    segments = P.fast_segments(path, speed, min_points)
    points = path.select("match_id", "row", "n", "frame_idx", "ts_s", "cx", "cy")
    first = points.withColumnRenamed("row", "first_row")
    ends = points.select("match_id", F.col("row").alias("end_row"), F.col("cy").alias("end_y"))
    placed = segments.join(first, ["match_id", "first_row"]).withColumn("end_row", F.least(F.col("last_row") + 5, F.col("n")).cast("int"))
    dy = F.col("end_y") - F.col("cy")
    target = F.when(dy < -5, "top").when(dy > 5, "bottom")
    quick = F.least(F.lit(1.0), F.col("avg_speed") / (2 * speed))
    straight = F.greatest(F.lit(0.0), 1 - F.col("angle_std") / F.acos(F.lit(-1.0)))
    return placed.join(ends, ["match_id", "end_row"]).withColumn("target_goal", target).filter("target_goal IS NOT NULL").select(
        "match_id", "frame_idx", "ts_s", F.col("cx").alias("x"), F.col("cy").alias("y"), ((quick + straight) / 2).alias("confidence"),
        F.col("avg_speed").alias("speed"), "target_goal", F.col("n_points").alias("duration_frames"))


def recent_shot(points: DataFrame, shot_rows: DataFrame, seconds: float = 3.0) -> DataFrame:
    """points with the earliest shot at most `seconds` before; points without one are left out.

    A range join by buckets of that length: a shot is met from its own bucket and the next, so each point is
    compared with the shots of two buckets, not with all of its match.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    s = shot_rows.select(
        "match_id", F.col("frame_idx").alias("shot_frame"), F.col("ts_s").alias("shot_timestamp"), F.col("confidence").alias("shot_confidence"),
        F.col("target_goal").alias("shot_target"), F.explode(F.array(bucket("ts_s"), bucket("ts_s") + 1)).alias("bucket"))
    p = points.withColumn("bucket", bucket("ts_s"))
    gap = (F.col("frame_idx") - F.col("shot_frame")) / F.col("fps")
    own = points.columns
    # The sides come from explode, whose size Spark cannot tell.
    best = p.join(s.hint("merge"), ["match_id", "bucket"]).filter((gap >= 0) & (gap <= seconds)).groupBy(*own).agg(
        F.min_by(F.struct("shot_frame", "shot_timestamp", "shot_confidence", "shot_target"), "shot_frame").alias("shot"))
    return best.select(*own, "shot.*")


def goals(path: DataFrame, shot_rows: DataFrame, matches: DataFrame, confidence: float = 0.6, seconds: float = 3.0, apart: float = 5.0) -> DataFrame:
    """match_id, frame_idx, ts_s, x, y, confidence, goal_region, shot_frame, shot_timestamp; the best within `apart` seconds."""
    placed = path.join(matches.select("match_id", "fps", "width", "height"), "match_id")
    placed = placed.withColumn("goal_region", G.goal_region_of(F.col("cx"), F.col("cy"), F.col("width"), F.col("height")))
    inside = P.stays_in_goal(placed).filter("goal_region IS NOT NULL AND stays")
    points = inside.select("match_id", "row", "frame_idx", "ts_s", "cx", "cy", "fps", "goal_region")
    c = F.least(F.lit(1.0), F.col("shot_confidence") * 1.2)
    c = F.when(F.col("shot_target") == F.col("goal_region"), F.least(F.lit(1.0), c * 1.1)).otherwise(c)
    found = recent_shot(points, shot_rows, seconds).withColumn("confidence", c).filter(F.col("confidence") >= confidence)
    rows = found.select("match_id", "frame_idx", "ts_s", F.col("cx").alias("x"), F.col("cy").alias("y"), "confidence", "goal_region", "shot_frame", "shot_timestamp")
    return dedup_events(rows, apart)


def dedup_events(df: DataFrame, seconds: float = 5.0, fold: int = FOLD, size: int | None = None) -> DataFrame:
    """The best event of every window: the first event opens one of `seconds` (its end belongs), the next event behind it the next.

    Of equal confidences the earliest stays. Windows follow from each other. A match of at most `fold` events is one row,
    whose windows are folded; in a longer one every event points to the first event behind its own window, and doubling
    the pointers finds in a few rounds which events open windows, whatever the length of a match.
    """
    rows = io.saved(df, "events")
    counts = io.saved(rows.groupBy("match_id").agg((F.count(F.lit(1)) > fold).alias("many")), "event-counts")
    few = counts.filter("NOT many").select("match_id")
    # Null is a match like others.
    own = rows.select(F.struct("*").alias("event"), "match_id", "ts_s", "frame_idx", "confidence")
    among = lambda keys: own.join(keys.select(F.col("match_id").alias("key_id")).hint("merge"), F.col("match_id").eqNullSafe(F.col("key_id")), "left_semi")
    best = folded_windows(among(few), seconds)
    if not counts.filter("many").isEmpty():
        best = best.unionByName(doubled_windows(among(counts.filter("many")), seconds, size))
    return best.select("event.*")


def folded_windows(rows: DataFrame, seconds: float) -> DataFrame:
    """The best event of every window of matches short enough for one row each."""
    listed = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("ts_s", "frame_idx", "confidence", "event")), lambda a, b: (
        F.when(a["ts_s"] < b["ts_s"], -1).when(a["ts_s"] > b["ts_s"], 1).when(a["frame_idx"] < b["frame_idx"], -1).when(a["frame_idx"] > b["frame_idx"], 1).otherwise(0))).alias("list"))
    kind = dict(listed.dtypes)["list"]
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast(kind).alias("done"), F.lit(None).cast(kind[6:-1]).alias("best"))

    def step(held, x):
        opens = held["anchor"].isNull() | (x["ts_s"] - held["anchor"] > seconds)
        done = F.when(opens & held["best"].isNotNull(), F.array_append(held["done"], held["best"])).otherwise(held["done"])
        best = F.when(opens | (x["confidence"] > held["best"]["confidence"]), x).otherwise(held["best"])
        return F.struct(F.when(opens, x["ts_s"]).otherwise(held["anchor"]).alias("anchor"), done.alias("done"), best.alias("best"))

    windows = F.aggregate("list", start, step, lambda held: F.array_append(held["done"], held["best"]))
    return listed.select(F.explode(windows).alias("x")).select("x.event")


def doubled_windows(rows: DataFrame, seconds: float, size: int | None = None) -> DataFrame:
    """The same for matches of any length: no task holds a match."""
    key = ["match_id"]
    size = size or slices.SLICE
    placed = io.saved(slices.row_numbers(rows, key, ["ts_s", "frame_idx"]), "event-rows")
    state = io.saved(_pointers(placed, seconds).withColumn("opens", F.col("row") == 1), "event-pointers")
    while True:
        # Openers point to openers; pointers then reach twice as far.
        told = state.filter("opens AND next IS NOT NULL").select(F.col("match_id").alias("to_id"), F.col("next").alias("to_row")).distinct()
        far = state.select(F.col("match_id").alias("far_id"), F.col("row").alias("far_row"), F.col("next").alias("far_next"))
        step = (
            state.join(told.hint("merge"), F.col("match_id").eqNullSafe(F.col("to_id")) & (F.col("row") == F.col("to_row")), "left")
            .join(far.hint("merge"), F.col("match_id").eqNullSafe(F.col("far_id")) & (F.col("next") == F.col("far_row")), "left")
            .select("match_id", "row", F.col("far_next").alias("next"), (F.col("opens") | F.col("to_row").isNotNull()).alias("opens"))
        )
        state = io.saved(step, "event-pointers")
        if state.filter("opens AND next IS NOT NULL").isEmpty():
            break
    opens = state.filter("opens").select(F.col("match_id").alias("open_id"), F.col("row").alias("open_row"))
    marked = io.saved(placed.join(opens.hint("merge"), F.col("match_id").eqNullSafe(F.col("open_id")) & (F.col("row") == F.col("open_row")), "left").drop("open_id").withColumn("slice", slices.slice_of(F.col("row"), size)), "event-openers")
    # An event's window is opened by the last opener up to it, in its slice or in one before.
    last = marked.groupBy(*key, "slice").agg(F.max("open_row").alias("last_open"))
    before = last.withColumn("open_before", F.max("last_open").over(W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("match_id").alias("slice_id"), F.col("slice").alias("slice_no"), "open_before")
    here = F.max("open_row").over(W.partitionBy(*key, "slice").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    same = F.col("match_id").eqNullSafe(F.col("slice_id")) & (F.col("slice") == F.col("slice_no"))
    windows = marked.withColumn("here", here).join(io.saved(before, "slice-openers").hint("merge"), same).withColumn("window", F.coalesce("here", "open_before"))
    return windows.groupBy(*key, "window").agg(F.max_by("event", F.struct("confidence", -F.col("row"))).alias("event")).select("event")


def _pointers(placed: DataFrame, seconds: float) -> DataFrame:
    """match_id, row, next: the first row more than `seconds` behind, null where there is none.

    Windows run per slice of time, into which the rows of the following two are copied. They count the rows that are
    surely in reach and those that may be; where a time difference is so close to `seconds` that rounding decides, the
    rows between are looked at one by one.
    """
    close = 1e-6 * (1 + seconds)
    own = F.floor(F.col("ts_s") / (4 * seconds))
    copied = placed.select("match_id", "row", "n", "ts_s", own.alias("own")).withColumn("part", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    # A range in fractions of a second can be given in SQL only.
    reach = lambda s: F.expr(f"max(row) OVER (PARTITION BY match_id, part ORDER BY CAST(ts_s AS DOUBLE) RANGE BETWEEN UNBOUNDED PRECEDING AND {s!r}D FOLLOWING)")
    found = copied.withColumns({"sure": reach(seconds - close), "maybe": reach(seconds + close)}).filter("part = own").select("match_id", "row", "n", "ts_s", "sure", "maybe")
    found = io.saved(found, "event-reach")
    times = placed.select(F.col("match_id").alias("at_id"), F.col("row").alias("at_row"), F.col("ts_s").alias("at_s"))
    unsure = found.filter("maybe > sure").withColumn("at", F.explode(F.sequence(F.col("sure") + 1, F.col("maybe"))))
    inside = unsure.join(times.hint("merge"), F.col("match_id").eqNullSafe(F.col("at_id")) & (F.col("at") == F.col("at_row"))).filter(F.col("at_s") - F.col("ts_s") <= seconds)
    more = inside.groupBy("match_id", "row").agg(F.max("at").alias("last")).select(F.col("match_id").alias("more_id"), F.col("row").alias("more_row"), "last")
    out = found.join(more.hint("merge"), F.col("match_id").eqNullSafe(F.col("more_id")) & (F.col("row") == F.col("more_row")), "left")
    after = F.coalesce("last", "sure") + 1
    return out.select("match_id", "row", F.when(after <= F.col("n"), after).alias("next"))


def all_events(shot_rows: DataFrame, goal_rows: DataFrame) -> DataFrame:
    """Shots and goals as one table: event_type, frame_idx, ts_s, confidence, x, y and the fields of both."""
    s = shot_rows.withColumn("event_type", F.lit("shot"))
    g = goal_rows.withColumn("event_type", F.lit("goal"))
    return s.unionByName(g, allowMissingColumns=True)


def in_time_order(df: DataFrame) -> DataFrame:
    """Shots stand before goals of the same time."""
    return df.orderBy("match_id", "ts_s", F.when(F.col("event_type") == "shot", 0).otherwise(1), "frame_idx")


def score_timeline(goal_rows: DataFrame) -> DataFrame:
    """match_id, ts_s, frame_idx, team_a, team_b, confidence, goal_region: the score after every goal."""
    run = W.partitionBy("match_id").orderBy("ts_s", "frame_idx").rowsBetween(W.unboundedPreceding, 0)
    count = lambda region: F.sum((F.col("goal_region") == region).cast("long")).over(run)
    return goal_rows.select("match_id", "ts_s", "frame_idx", count("top").alias("team_a"), count("bottom").alias("team_b"), "confidence", "goal_region")


def final_score(goal_rows: DataFrame) -> DataFrame:
    return goal_rows.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("goals"), F.count_if(F.col("goal_region") == "top").alias("team_a"), F.count_if(F.col("goal_region") == "bottom").alias("team_b"))
