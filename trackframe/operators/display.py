"""What a viewer shows: labels, colours, event lines, trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import boxes

#: Fixed display colours as B, G, R text.
COLORS = {"player": "0,255,0", "ball": "0,0,255", "other": "128,128,128", "ours": "255,0,0", "opponent": "0,0,255"}


def label_text(df: DataFrame, show_conf: bool = True, show_ids: bool = True) -> DataFrame:
    parts = [F.col("object_type")]
    if show_conf:
        parts.append(F.format_string("%.2f", "confidence"))
    if show_ids and "track_id" in df.columns:
        parts.append(F.concat(F.lit("ID:"), F.col("track_id").cast("string")))
    return df.withColumn("label", F.concat_ws(" ", *parts))


def display_color(df: DataFrame, colors: dict[str, str] = COLORS) -> DataFrame:
    """Players have their team's colour, if it is ours or the opponent's; a team changes nothing else."""
    player = F.when(F.col("team_name") == "ours", colors["ours"]).when(F.col("team_name") == "opponent", colors["opponent"]).otherwise(colors["player"])
    kind = F.col("object_type")
    return df.withColumn("color", F.when(kind == "player", player).when(kind == "ball", colors["ball"]).otherwise(colors["other"]))


def event_display(df: DataFrame, matches: DataFrame) -> DataFrame:
    """Clock, marker position in % of the match's duration (1 if that is 0 or unknown), high from 0.7, details."""
    duration = F.when(F.col("match_duration") != 0, F.col("match_duration")).otherwise(1.0)
    speed = F.when((F.col("event_type") == "shot") & (F.col("speed") != 0), F.concat(F.lit("Speed: "), F.format_string("%.1f", "speed"), F.lit("px/f")))
    region = F.concat(F.when(F.col("event_type") == "shot", " • Target: ").otherwise(" • Region: "), F.col("region"))
    known = df.join(matches.select("match_id", F.col("duration").alias("match_duration")), "match_id", "left")
    return known.withColumns({
        "clock": G.clock(F.col("ts_s")), "marker": F.col("ts_s") / duration * 100, "high": F.col("confidence") >= 0.7,
        "details": F.concat_ws("", speed, region)}).drop("match_duration")


def event_fields(df: DataFrame) -> DataFrame:
    """Fields as text with defaults: N/A, unknown, no shot."""
    return df.withColumns({
        "speed_text": F.when(F.col("speed").isNull(), "N/A").otherwise(F.format_string("%.1f", "speed")), "target_text": F.coalesce("target_goal", F.lit("unknown")),
        "region_text": F.coalesce("goal_region", F.lit("unknown")),
        "shot_text": F.when(F.col("shot_timestamp").isNull(), "no shot").otherwise(F.concat(F.lit("shot@"), F.format_string("%.1f", "shot_timestamp"), F.lit("s")))})


def trails(tracks: DataFrame, length: int = 30) -> DataFrame:
    """The last centres of each track up to each of its frames (two at least) and the thickness of each segment; boxes that are not finite have none."""
    run = W.partitionBy("match_id", "track_id").orderBy("frame_idx").rowsBetween(1 - length, 0)
    center = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    out = boxes.valid_boxes(tracks).withColumn("trail", F.collect_list(center).over(run)).withColumn("n_trail", F.size("trail")).filter("n_trail >= 2")
    width = F.transform(F.sequence(F.lit(1), F.col("n_trail") - 1), lambda i: F.greatest(F.lit(1), F.floor(3 * i / F.col("n_trail")).cast("int")))
    return out.select("match_id", "track_id", "frame_idx", "n_trail", "trail", width.alias("thickness"))
