"""A catalogue of saved runs: root/<run>/events.jsonl, score_timeline.json, run_manifest.json, video_metadata.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import reports
from trackframe.sources import io
from trackframe.sources.catalogue import read_runs

FILES = {"has_events": "events.jsonl", "has_timeline": "score_timeline.json", "has_manifest": "run_manifest.json"}
#: A run has one of these at least.
KNOWN = (*FILES.values(), "video_metadata.json", "teams.json")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """run, a flag per kind of file, fps, duration, width, height, and counts of events (0 where there are none)."""
    at = read_runs(spark, root).filter(F.col("file").isin(*KNOWN))
    flags = at.groupBy("run").agg(*[F.max(F.col("file") == f).alias(n) for n, f in FILES.items()])
    meta = read_runs(spark, root, "video_metadata.json", io.MATCHES).select("run", "fps", "duration", "width", "height")
    counts = reports.event_type_counts(read_runs(spark, root, "events.jsonl", "event_type STRING"), "run")
    # Both sides come from Python; a run is a row.
    out = flags.join(meta.hint("merge"), "run", "left").join(counts.hint("merge"), "run", "left")
    return out.fillna(0, ["n_shot", "n_goal", "n_other"])


def run_metadata(spark: SparkSession, root: str, run: str) -> DataFrame:
    """One row: run, and as structs the run's video_metadata, manifest and teams, each null where the run has none."""
    out = spark.createDataFrame([(run,)], "run string")
    for name, file, schema in (("video_metadata", "video_metadata.json", io.MATCHES), ("manifest", "run_manifest.json", io.MANIFEST), ("teams", "teams.json", io.TEAMS)):
        doc = read_runs(spark, root, file, schema, run).drop("match_id")
        out = out.join(doc.select("run", F.struct(*[c for c in doc.columns if c != "run"]).alias(name)).hint("merge"), "run", "left")
    return out


def run_events(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The run's events, each with their number. No file of another run is opened."""
    rows = read_runs(spark, root, "events.jsonl", io.EVENTS, run)
    # One row is broadcast; for it, lines are counted and not parsed.
    count = read_runs(spark, root, "events.jsonl", "", run).groupBy("run").agg(F.count(F.lit(1)).alias("n_events"))
    return rows.join(F.broadcast(count), "run")
