"""Teams from colours: samples, means, clusters, names, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions import color as C
from trackframe.operators import boxes
from trackframe.operators.clusters import kmeans

UNKNOWN = (-1, "unknown")
#: Starts and rounds of k-means over a box's colours, and the move of a centre at which it ends.
COLOR_STARTS, COLOR_ROUNDS, COLOR_EPS = 3, 10, 1.0


def valid_colors(df: DataFrame) -> DataFrame:
    """Rows whose colour was found: not all three channels near 0."""
    return df.filter((F.abs("b") > 1e-8) | (F.abs("g") > 1e-8) | (F.abs("r") > 1e-8))


def color_samples(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of player tracks with finite boxes on the frames (match_id, frame_idx) at hand."""
    return boxes.valid_boxes(tracks.filter("object_type = 'player'")).join(frames, ["match_id", "frame_idx"], "left_semi")


def track_mean_color(samples: DataFrame, least: int = 3) -> DataFrame:
    out = samples.groupBy("match_id", "track_id").agg(F.avg("b").alias("b"), F.avg("g").alias("g"), F.avg("r").alias("r"), F.count(F.lit(1)).alias("n_samples"))
    return out.filter(F.col("n_samples") >= least)


def pixels_in_boxes(pixels: DataFrame, areas: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels (frame_idx, x, y, b, g, r) in areas (box_id, frame_idx, x1, y1, x2, y2), lower bounds included.

    Areas are listed under the tiles they meet, so that a pixel meets only the areas of its tile.
    """
    t = lambda c: F.floor(F.col(c) / tile)
    last = lambda c: F.floor((F.col(c) - 1) / tile)
    some = areas.filter("x2 > x1 AND y2 > y1")
    tiled = some.withColumn("tile_x", F.explode(F.sequence(t("x1"), last("x2")))).withColumn("tile_y", F.explode(F.sequence(t("y1"), last("y2"))))
    at = pixels.withColumns({"tile_x": t("x"), "tile_y": t("y")})
    met = at.join(tiled.hint("merge"), ["frame_idx", "tile_x", "tile_y"]).filter("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    return met.select("box_id", "frame_idx", "x", "y", "b", "g", "r")


def sampled_areas(areas: DataFrame, region: str, width: int, height: int) -> DataFrame:
    """Boxes cut down to the pixels that are sampled in a frame of this size: region is upper, center or full."""
    rect = C.sample_rect(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(width), F.lit(height), region)
    out = areas.withColumn("rect", rect).filter("rect IS NOT NULL")
    return out.select("box_id", "frame_idx", *[F.col(f"rect.r{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def region_mean_color(pixels: DataFrame, areas: DataFrame, extract: Callable[[Column, Column, Column], dict[str, Column]] | None = None, region: str | None = None, size: tuple[int, int] | None = None, most: int | None = None) -> DataFrame:
    """Mean colour per box, or what the caller's aggregate columns over (b, g, r) make of its pixels; of a region, with the frame's size.

    The columns may be Spark's aggregates, which keep a few numbers per box, or all of them grouped-aggregate pandas UDFs
    of the caller's own Python, which get a box's pixels at once. `most` bounds those: a box is known to have no more
    pixels than its area, and one whose area is larger ends the job with an error before any pixel is gathered.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    cols = extract(b, g, r) if extract else {"b": F.avg(b), "g": F.avg(g), "r": F.avg(r)}
    some = areas if region is None else sampled_areas(areas, region, *size)
    if most is not None:
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        some = some.filter(F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (area > most), F.raise_error(F.format_string(f"box %s has more than {most} pixels", F.col("box_id").cast("string"))).cast("boolean")).otherwise(True))
    return pixels_in_boxes(pixels, some).groupBy("box_id").agg(*[c.alias(n) for n, c in cols.items()])


def predict_team(colors: DataFrame, centers: list[tuple[int, tuple[float, float, float]]], space: str = "hsv") -> DataFrame:
    """Nearest centre (team_id, (b, g, r)) for every colour; the lowest id on ties. Centres are a parameter, so they are literals."""
    lit = [tuple(F.lit(float(v)) for v in c) for _, c in centers]
    own = (F.col("b"), F.col("g"), F.col("r"))
    if space == "hsv":
        hsv = lambda c: C.bgr_to_hsv(*c)
        parts = lambda s: (s["h"], s["s"], s["v"])
        dist = [C.hsv_distance(parts(hsv(own)), parts(hsv(c))) for c in lit]
    else:
        dist = [C.bgr_distance(own, c) for c in lit]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("team_id")) for d, (i, _) in zip(dist, centers, strict=True)]))
    return colors.withColumns({"team_id": best["team_id"], "distance": best["d"]})


def assign_teams(samples: DataFrame, k: int = 2, min_samples: int = 3, space: str = "hsv") -> DataFrame:
    """match_id, track_id, team_id and the team's centre (in HSV or BGR); matches with fewer tracks than k have no row."""
    found = track_mean_color(valid_colors(samples), min_samples)
    found = found.withColumn("tracks", F.count(F.lit(1)).over(W.partitionBy("match_id"))).filter(F.col("tracks") >= k)
    x = C.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r")) if space == "hsv" else F.struct("b", "g", "r")
    features = list(space)
    mean = found.select("match_id", "track_id", x.alias("x")).select("match_id", "track_id", "x.*")
    return kmeans(mean, ["match_id"], features, k).withColumnRenamed("cluster", "team_id").drop(*features, "n_points")


def dominant_color(pixels: DataFrame, areas: DataFrame, k: int = 3, region: str | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Centre of the largest of k clusters of each box's pixels (first by centre on ties); of a region, with the frame's size.

    Pixels count once per colour of their box, with weights.
    """
    some = areas if region is None else sampled_areas(areas, region, *size)
    colors = pixels_in_boxes(pixels, some).groupBy("box_id", "b", "g", "r").agg(F.count(F.lit(1)).alias("n"))
    found = kmeans(colors, ["box_id"], ["b", "g", "r"], k, "n", COLOR_STARTS, COLOR_ROUNDS, COLOR_EPS)
    best = F.max_by(F.struct("c_b", "c_g", "c_r", "n_points"), F.struct("n_points", -F.col("cluster"))).alias("best")
    return found.groupBy("box_id").agg(best).select("box_id", F.col("best.c_b").alias("b"), F.col("best.c_g").alias("g"), F.col("best.c_r").alias("r"), F.col("best.n_points").alias("n_points"))


def name_teams(teams: DataFrame, names: dict[int, str] | None = None, ours: int | None = None) -> DataFrame:
    """team_name by a given map, or ours/opponent, or team_A to team_D by id; team_<id> beyond."""
    i = F.col("team_id")
    other = F.when(i.between(0, 3), F.concat(F.lit("team_"), F.get(F.lit(["A", "B", "C", "D"]), i.cast("int")))).otherwise(F.concat(F.lit("team_"), i.cast("string")))
    if ours is not None:
        other = F.when(i == ours, "ours").otherwise("opponent")
    for k, v in (names or {}).items():
        other = F.when(i == k, v).otherwise(other)
    return teams.withColumn("team_name", other)


def label_tracks(tracks: DataFrame, track_teams: DataFrame, teams: DataFrame) -> DataFrame:
    """tracks with team_id and team_name; -1 and unknown where none is assigned."""
    named = track_teams.join(teams.select("match_id", "team_id", "team_name"), ["match_id", "team_id"], "left")
    out = tracks.drop("team_id", "team_name").join(named, ["match_id", "track_id"], "left")
    return out.withColumns({"team_id": F.coalesce("team_id", F.lit(UNKNOWN[0])), "team_name": F.coalesce("team_name", F.lit(UNKNOWN[1]))})


def team_roster(teams: DataFrame, track_teams: DataFrame) -> DataFrame:
    return teams.join(track_teams, ["match_id", "team_id"], "left").groupBy("match_id", "team_id", "team_name").agg(F.count("track_id").alias("n_tracks"))
