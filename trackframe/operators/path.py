"""The ball's path: one row per point, in order of (frame_idx, track_id) within the match.

Rows are numbered once (`slices.row_numbers`); what looks at neighbours runs over slices of a match, so that a match of
any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.operators import slices

KEY = ["match_id"]


def ball_path(tracks: DataFrame) -> DataFrame:
    """match_id, row (from 1), n, track_id, frame_idx, ts_s, cx, cy, confidence of all ball tracks as one path."""
    ball = tracks.filter("object_type = 'ball'").select(
        "match_id", "track_id", "frame_idx", "ts_s", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "confidence")
    return numbered(ball)


def numbered(points: DataFrame) -> DataFrame:
    return slices.row_numbers(points, KEY, ["frame_idx", "track_id"])


def velocity(path: DataFrame, size: int | None = None) -> DataFrame:
    """vx, vy, speed per frame: forward at the first row, backward at the last, central elsewhere; 0 where no frame passes, null for a single point."""

    def columns(w):
        before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
        after = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
        dt = after("frame_idx") - before("frame_idx")
        part = lambda c: F.when(F.col("n") < 2, None).when(dt > 0, (after(c) - before(c)) / dt).otherwise(0.0)
        return {"vx": part("cx"), "vy": part("cy")}

    return slices.over_slices(path, KEY, 1, 1, columns, size).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def smooth(path: DataFrame, window: int = 3, size: int | None = None) -> DataFrame:
    """Means of the velocity over the rows around; paths shorter than the window stay as they are."""
    half = window // 2
    mean = lambda c, w: F.when(F.col("n") < window, F.col(c)).otherwise(F.avg(c).over(w.rowsBetween(-half, half)))
    out = slices.over_slices(path, KEY, half, half, lambda w: {"vx": mean("vx", w), "vy": mean("vy", w)}, size)
    return out.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def fast_segments(path: DataFrame, threshold: float, least: int = 3, size: int | None = None) -> DataFrame:
    """Maximal runs of speed >= threshold with at least so many points: match_id, first_row, last_row, n_points, avg_speed, angle_std.

    Runs are found per slice as summaries that can be merged: rows, points, and the sums behind mean and deviation. Those
    that touch a border of their slice are open and are merged in order where they adjoin; all others are whole.
    """
    size = size or slices.SLICE
    fast = path.filter(F.col("speed") >= threshold).withColumn("slice", slices.slice_of(F.col("row"), size)).withColumn("angle", F.atan2("vy", "vx"))
    island = fast.withColumn("island", F.col("row") - F.row_number().over(W.partitionBy(*KEY, "slice").orderBy("row")))
    runs = island.groupBy(*KEY, "slice", "island").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("n_points"), F.avg("speed").alias("speed"),
        F.avg("angle").alias("angle"), (F.var_pop("angle") * F.count(F.lit(1))).alias("squares"), F.max("n").alias("n"))
    at_start = (F.col("first_row") == F.col("slice") * size + 1) & (F.col("slice") > 0)
    at_end = (F.col("last_row") == (F.col("slice") + 1) * size) & (F.col("last_row") < F.col("n"))
    runs = runs.withColumn("open", at_start | at_end)
    # Two rows per slice at most: an open run that does not begin where the last one ended begins a new one.
    order = W.partitionBy(*KEY, "open").orderBy("first_row")
    begins = (~F.col("open") | F.coalesce(F.lag("last_row").over(order) + 1 != F.col("first_row"), F.lit(True))).cast("int")
    whole = runs.filter("NOT open").withColumn("run", F.col("first_row"))
    opened = runs.filter("open").withColumn("begins", begins).withColumn("run", F.max(F.when(F.col("begins") == 1, F.col("first_row"))).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("begins")
    n, mean = F.sum("n_points"), lambda c: F.sum(F.col(c) * F.col("n_points")) / F.sum("n_points")
    spread = F.sum(F.col("squares") + F.col("n_points") * F.col("angle") * F.col("angle")) / n - mean("angle") * mean("angle")
    merged = opened.groupBy(*KEY, "run").agg(
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), n.alias("n_points"), mean("speed").alias("avg_speed"), F.sqrt(F.greatest(F.lit(0.0), spread)).alias("angle_std"))
    single = whole.select(*KEY, "first_row", "last_row", "n_points", F.col("speed").alias("avg_speed"), F.sqrt(F.col("squares") / F.col("n_points")).alias("angle_std"))
    return single.unionByName(merged.drop("run")).filter(F.col("n_points") >= least)


def direction_changes(path: DataFrame, degrees: float = 45.0, size: int | None = None) -> DataFrame:
    """Inner rows whose velocity turns by at least this angle to the next row's."""

    def columns(w):
        nx, ny = F.lead("vx").over(w), F.lead("vy").over(w)
        a, b = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), F.sqrt(nx * nx + ny * ny)
        cos = (F.col("vx") * nx + F.col("vy") * ny) / (a * b)
        return {"angle": F.when((a >= 1e-6) & (b >= 1e-6), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))}

    turned = slices.over_slices(path, KEY, 0, 1, columns, size)
    return turned.filter((F.col("row") > 1) & (F.col("row") < F.col("n")) & (F.col("angle") >= degrees))


def stays_in_goal(path: DataFrame, rows: int = 10, region: str = "goal_region", height: str = "height", size: int | None = None) -> DataFrame:
    """Column stays: at least half of this and the next rows are in the goal or near its line; true near the path's end."""
    near = (F.col(region).isNotNull() | (F.col("cy") < F.col(height) * 0.2) | (F.col("cy") > F.col(height) * 0.8)).cast("int")
    inside = lambda w: F.sum(near).over(w.rowsBetween(0, rows - 1))
    return slices.over_slices(path, KEY, 0, rows - 1, lambda w: {"stays": (F.col("row") - 1 + rows >= F.col("n")) | (2 * inside(w) >= rows)}, size)
