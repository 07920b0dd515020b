"""Operators over detections: columns match_id, frame_idx, object_type, x1, y1, x2, y2, confidence and others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import slices


def box_geometry(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "width": F.col("x2") - F.col("x1"),
        "height": F.col("y2") - F.col("y1"), "area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")),
    })


def classify_boxes(df: DataFrame, player: int = 0, ball: int = 32, min_conf: float = 0.5) -> DataFrame:
    kind = F.when(F.col("class_id") == player, "player").when(F.col("class_id") == ball, "ball")
    return df.filter(F.col("class_id").isin(player, ball) & (F.col("confidence") >= min_conf)).withColumn("object_type", kind)


def sample_frames(df: DataFrame, strategy: str = "every_frame", interval: int = 1, start: int = 0, end: int | None = None) -> DataFrame:
    """strategy: every_frame, every_2nd or every_nth; frames from start up to end, which does not belong. Reaches the scan as a filter."""
    step = {"every_frame": 1, "every_2nd": 2, "every_nth": interval}[strategy]
    out = df.filter(F.col("frame_idx") >= start)
    out = out if end is None else out.filter(F.col("frame_idx") < end)
    return out if step == 1 else out.filter(F.col("frame_idx") % step == 0)


def with_match(df: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per match has a few numbers; Spark broadcasts it by its size or shuffles."""
    return df.join(matches, "match_id")


def with_time(df: DataFrame, matches: DataFrame) -> DataFrame:
    return with_match(df, matches.select("match_id", "fps")).withColumn("ts_s", F.col("frame_idx") / F.col("fps"))


def with_frame(df: DataFrame, matches: DataFrame) -> DataFrame:
    return with_match(df, matches.select("match_id", "fps")).withColumn("frame_idx", F.floor(F.col("ts_s") * F.col("fps")))


def sample_present_frames(df: DataFrame, every: int = 30) -> DataFrame:
    """Rows of every so many-th frame among those present, by rank within the match."""
    rank = slices.free(df.columns, "frame_rank")
    return slices.dense_rank(df, ["match_id"], ["frame_idx"], rank).filter((F.col(rank) - 1) % every == 0).drop(rank)


def players(df: DataFrame) -> DataFrame:
    return df.filter(F.col("object_type") == "player")


def balls(df: DataFrame) -> DataFrame:
    return df.filter(F.col("object_type") == "ball")


def events_of(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("event_type") == kind)


def team(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("team_name") == name)


def time_slice(df: DataFrame, end: float = 60.0) -> DataFrame:
    return df.filter(F.col("ts_s") <= end)


def high_conf(df: DataFrame, kind: str | None = "ball", least: float = 0.8) -> DataFrame:
    out = df.filter(F.col("confidence") > least)
    return out if kind is None else out.filter(F.col("object_type") == kind)


def large(df: DataFrame, kind: str = "player", area: float = 100_000) -> DataFrame:
    return df.filter((F.col("object_type") == kind) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > area))


def valid_boxes(df: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        ok = ok & G.finite(F.col(c))
    return df.filter(ok)


def player_centers(df: DataFrame) -> DataFrame:
    return box_geometry(players(df)).select("match_id", "track_id", "frame_idx", "ts_s", "cx", "cy", "team_name")


def iou_pairs(left: DataFrame, right: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Pairs of boxes of one type on one frame key (match_id, pair_frame) with at least this overlap.

    The equal keys make it a hash or merge join; the overlap test leaves only boxes that meet.
    """
    keys = ["match_id", "pair_frame", "object_type"]
    box = ("x1", "y1", "x2", "y2")
    own = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("slot", *box)])
    a, b = own(left, "a"), own(right, "b")
    both = a.join(b, keys).filter("a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    value = G.iou(tuple(F.col(f"a_{c}") for c in box), tuple(F.col(f"b_{c}") for c in box))
    return both.withColumn("iou", value).filter(F.col("iou") >= min_iou).select(*keys, "a_slot", "b_slot", "iou")


def goal_regions(matches: DataFrame, edge: float = 0.15, width: float = 0.3) -> DataFrame:
    """Two rows per match: name, x_min, x_max, y_min, y_max."""
    w, h = F.col("width"), F.col("height")
    one = lambda name, lo, hi: F.struct(
        F.lit(name).alias("name"), (w * (0.5 - width / 2)).alias("x_min"), (w * (0.5 + width / 2)).alias("x_max"), lo.cast("double").alias("y_min"), hi.cast("double").alias("y_max"))
    return matches.select("match_id", F.inline(F.array(one("top", F.lit(0.0), h * edge), one("bottom", h * (1 - edge), h))))
