"""Aggregate reports, a row or group per match. Counts of distinct values are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.operators.quantiles import exact_quantiles
from trackframe.sources import io

BY = "match_id"


def _many(name: str, alias: str):
    return F.count_distinct(name).alias(alias)


def detection_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(BY).agg(
        F.count(F.lit(1)).alias("n_rows"), _many("frame_idx", "n_frames"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), (F.max("ts_s") / 60).alias("minutes"))


def type_counts(df: DataFrame, key: str = "object_type") -> DataFrame:
    return df.groupBy(BY, key).agg(F.count(F.lit(1)).alias("n")).orderBy(BY, F.desc("n"), key)


def _with_quantiles(stats: DataFrame, rows: DataFrame, key: list[str], col: str, at: dict[str, float]) -> DataFrame:
    """stats (a row per key) with the quantiles of rows, a written table; null where a group has no value."""
    q = exact_quantiles(rows, key, col, list(at.values()), written=True)
    q = q.select(*[F.col(c).alias(f"{c}_of_q") for c in key], *[F.get("q", i).alias(name) for i, name in enumerate(at)])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_q")) for c in key]
    return stats.join(q.hint("merge"), same, "left").drop(*[f"{c}_of_q" for c in key])


def per_frame_stats(df: DataFrame) -> DataFrame:
    """Mean and median rows per frame, balls included."""
    frames = io.saved(df.groupBy(BY, "frame_idx").count(), "frame-rows")
    return _with_quantiles(frames.groupBy(BY).agg(F.avg("count").alias("mean_rows")), frames, [BY], "count", {"median_rows": 0.5})


def describe_by(df: DataFrame, key: str = "object_type", col: str = "confidence") -> DataFrame:
    rows = io.saved(df.select(BY, key, col), "described")
    out = rows.groupBy(BY, key).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("lowest"), F.max(col).alias("highest"))
    return _with_quantiles(out, rows, [BY, key], col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(BY, key, "n", "mean", "std", "lowest", "p25", "p50", "p75", "highest")


def ball_rate(df: DataFrame) -> DataFrame:
    ball = F.count_if(F.col("object_type") == "ball")
    return df.groupBy(BY).agg(ball.alias("n_balls"), (100 * ball / F.count_distinct("frame_idx")).alias("ball_rate"))


def frame_summary(df: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("object_type") == t)
    return df.groupBy(BY, "frame_idx").agg(
        F.concat(count("player").cast("string"), F.lit(" players, "), count("ball").cast("string"), F.lit(" balls")).alias("objects"),
        F.min_by("ts_s", "slot").alias("ts_s"), F.avg("confidence").alias("mean_confidence"))


def busy_frames(df: DataFrame, over: int = 20) -> DataFrame:
    return df.filter("object_type = 'player'").groupBy(BY, "frame_idx").agg(F.count(F.lit(1)).alias("n_players")).filter(F.col("n_players") > over)


def busy_frame_times(df: DataFrame, over: int = 20, frames: int = 5) -> DataFrame:
    """Distinct times of the first busy frames."""
    first = busy_frames(df, over).withColumn("k", F.row_number().over(W.partitionBy(BY).orderBy("frame_idx"))).filter(F.col("k") <= frames)
    return df.join(first.select(BY, "frame_idx"), [BY, "frame_idx"], "left_semi").select(BY, "frame_idx", "ts_s").distinct()


def track_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(BY).agg(
        F.count(F.lit(1)).alias("n_points"), _many("track_id", "n_tracks"), _many("frame_idx", "n_frames"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


def tracks_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "object_type").agg(_many("track_id", "n_tracks"))


def track_lengths(df: DataFrame, *more: str) -> DataFrame:
    return df.groupBy(BY, "track_id", *more).agg(F.count(F.lit(1)).alias("length"))


def track_length_stats(df: DataFrame) -> DataFrame:
    lengths = io.saved(track_lengths(df), "track-lengths")
    stats = lengths.groupBy(BY).agg(F.avg("length").alias("mean_length"), F.max("length").alias("longest"), F.min("length").alias("shortest"))
    return _with_quantiles(stats, lengths, [BY], "length", {"median_length": 0.5})


def track_quality(df: DataFrame) -> DataFrame:
    return df.groupBy(BY).agg(F.avg("confidence").alias("mean_confidence"), F.avg("hits").alias("mean_hits"), F.avg("age").alias("mean_age"))


def long_tracks(df: DataFrame, over: int = 100, show: int = 10) -> DataFrame:
    """Number of tracks longer than `over`, and the first ids as text."""
    some = track_lengths(df).filter(F.col("length") > over)
    ranked = some.withColumn("k", F.row_number().over(W.partitionBy(BY).orderBy("track_id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= show, F.col("track_id")))), lambda x: x.cast("string")), ",")
    return ranked.groupBy(BY).agg(F.count(F.lit(1)).alias("n_long"), first.alias("first_ids"))


def short_tracks(df: DataFrame, under: int = 10) -> DataFrame:
    return track_lengths(df).filter(F.col("length") < under).groupBy(BY).agg(F.count(F.lit(1)).alias("n_short"))


def ball_track_stats(df: DataFrame) -> DataFrame:
    lengths = track_lengths(df.filter("object_type = 'ball'")).withColumn("object_type", F.lit("ball"))
    return describe_by(lengths, "object_type", "length")


def track_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "track_id").agg(
        F.min_by("object_type", "frame_idx").alias("object_type_first"), F.min("frame_idx").alias("frame_idx_min"), F.max("frame_idx").alias("frame_idx_max"),
        F.count("frame_idx").alias("frame_idx_count"), F.min("ts_s").alias("timestamp_min"), F.max("ts_s").alias("timestamp_max"),
        F.avg("confidence").alias("confidence_mean"), F.max("hits").alias("hits_max"), F.max("age").alias("age_max"))


def fragmentation(df: DataFrame) -> DataFrame:
    """Mean length by frames; Good over 0.5, Moderate over 0.2, else Poor."""
    ratio = df.groupBy(BY).agg((F.count(F.lit(1)) / F.count_distinct("track_id") / F.count_distinct("frame_idx")).alias("ratio"))
    return ratio.withColumn("grade", F.when(F.col("ratio") > 0.5, "Good").when(F.col("ratio") > 0.2, "Moderate").otherwise("Poor"))


def coverage(df: DataFrame) -> DataFrame:
    return df.groupBy(BY).agg((F.count(F.lit(1)) / F.count_distinct("frame_idx")).alias("coverage"))


def team_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "team_name").agg(_many("track_id", "n_tracks"), F.count(F.lit(1)).alias("n_points"))


def longest_tracks(df: DataFrame, n: int = 20) -> DataFrame:
    """The n longest (track, team) of each match."""
    rank = F.row_number().over(W.partitionBy(BY).orderBy(F.desc("length"), "track_id", "team_name"))
    return track_lengths(df, "team_name").withColumn("rank", rank).filter(F.col("rank") <= n)


def team_inconsistencies(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "track_id").agg(_many("team_id", "n_teams")).filter("n_teams > 1")


def team_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(BY, "team_id", "team_name").agg(
        _many("track_id", "track_id_nunique"), F.min("frame_idx").alias("frame_idx_min"), F.max("frame_idx").alias("frame_idx_max"),
        F.count("frame_idx").alias("frame_idx_count"), F.avg("confidence").alias("confidence_mean"))


def team_balance(df: DataFrame) -> DataFrame:
    """For matches with exactly two team names: largest by smallest number of tracks; over 1.5 is imbalanced."""
    tracks = df.groupBy(BY, "team_name").agg(F.count_distinct("track_id").alias("n"))
    two = tracks.groupBy(BY).agg(F.count(F.lit(1)).alias("teams"), (F.max("n") / F.min("n")).alias("ratio")).filter("teams = 2")
    return two.select(BY, "ratio", (F.col("ratio") > 1.5).alias("imbalanced"))


def event_health(df: DataFrame) -> DataFrame:
    """Flags of a match's events; matches without events have no row (see `health_of`)."""
    n, shot, goal = F.count(F.lit(1)), F.count_if(F.col("event_type") == "shot"), F.count_if(F.col("event_type") == "goal")
    return df.groupBy(BY).agg(
        (n == 0).alias("no_events"), ((shot > 0) & (goal == 0)).alias("no_goals"), (goal > 10).alias("many_goals"),
        (F.count_if(F.col("confidence") < 0.5) > 0.5 * n).alias("low_confidence"))


def health_of(matches: DataFrame, df: DataFrame) -> DataFrame:
    out = matches.select(BY).join(event_health(df), BY, "left")
    return out.select(BY, F.coalesce("no_events", F.lit(True)).alias("no_events"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("no_goals", "many_goals", "low_confidence")])


def event_type_counts(df: DataFrame, key: str = BY, types: tuple = ("shot", "goal", "other")) -> DataFrame:
    """Counts by type; a missing one counts as other."""
    kind = F.coalesce("event_type", F.lit("other"))
    return df.groupBy(key).agg(*[F.count_if(kind == t).alias(f"n_{t}") for t in types])


def top_shots(df: DataFrame, n: int = 10) -> DataFrame:
    """The n shots of highest confidence of each match."""
    rank = F.row_number().over(W.partitionBy(BY).orderBy(F.desc("confidence"), "frame_idx"))
    return df.filter("event_type = 'shot'").withColumn("rank", rank).filter(F.col("rank") <= n)


def event_timeline(df: DataFrame) -> DataFrame:
    return df.select(BY, "event_type", "ts_s", "confidence", "frame_idx").orderBy(BY, "ts_s", "frame_idx")


def sample_tracks(df: DataFrame, limit: int = 1000, seed: int = 42) -> DataFrame:
    """Exactly `limit` rows of each match, chosen by a seeded hash, sorted by frame, with the number of rows there are.

    The rank stands alone under its filter, so that each task keeps `limit` rows of a match before they are shuffled; the
    numbers are counted apart.
    """
    order = W.partitionBy(BY).orderBy(F.md5(F.concat_ws(":", "track_id", "frame_idx", F.lit(seed)).cast("binary")), "track_id", "frame_idx")
    some = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("rank")
    total = df.groupBy(BY).agg(F.count(F.lit(1)).alias("total")).withColumnRenamed(BY, "total_of")
    return some.join(total.hint("merge"), F.col(BY).eqNullSafe(F.col("total_of"))).drop("total_of").orderBy(BY, "frame_idx", "track_id")
