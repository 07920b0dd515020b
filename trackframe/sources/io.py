"""Tables and documents at rest. Inside, boxes are scalar columns and time is ts_s; files have arrays and `timestamp`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "match_id BIGINT, frame_idx BIGINT, timestamp DOUBLE, det_idx BIGINT, object_type STRING, class_id INT, bbox ARRAY<DOUBLE>, center ARRAY<DOUBLE>, confidence DOUBLE, width DOUBLE, height DOUBLE, area DOUBLE"
TRACKS = "match_id BIGINT, track_id BIGINT, frame_idx BIGINT, timestamp DOUBLE, object_type STRING, bbox ARRAY<DOUBLE>, confidence DOUBLE, age BIGINT, hits BIGINT, time_since_update BIGINT, team_id INT, team_name STRING"
EVENTS = "match_id BIGINT, event_type STRING, frame_idx BIGINT, timestamp DOUBLE, confidence DOUBLE, location ARRAY<DOUBLE>, metadata STRUCT<speed: DOUBLE, target_goal: STRING, duration_frames: BIGINT, goal_region: STRING, shot_frame: BIGINT, shot_timestamp: DOUBLE>"
MATCHES = "match_id BIGINT, fps DOUBLE, total_frames BIGINT, width INT, height INT, duration DOUBLE, codec STRING"
TEAMS = "match_id BIGINT, n_teams INT, team_colors MAP<STRING, ARRAY<DOUBLE>>, team_names MAP<STRING, STRING>, track_assignments MAP<STRING, STRING>"
SCORES = "match_id BIGINT, goals BIGINT, final_score STRUCT<team_a: BIGINT, team_b: BIGINT>, timeline ARRAY<STRUCT<timestamp: DOUBLE, frame_idx: BIGINT, score: STRUCT<team_a: BIGINT, team_b: BIGINT>, confidence: DOUBLE, goal_region: STRING>>"

MANIFEST = "match_id BIGINT, schema_version STRING, video_path STRING, output_dir STRING, start_time STRING, end_time STRING, config STRING, stages ARRAY<STRING>"


_own: dict[str, str] = {}
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where a session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="trackframe-")
    return _own[app]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one, for what is written on the way. It goes when the driver ends, or by `clear_scratch`."""
    app, shared = spark.sparkContext.applicationId, shared_dir(spark)
    path = f"{shared}/trackframe-{app}"
    if _scratch.get(app) != path:
        store, at = _hadoop(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _scratch[app] = path
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _hadoop(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that has been written on the way. Results that have not been read or written by then are lost."""
    remove(spark, scratch_dir(spark))
    _scratch.pop(spark.sparkContext.applicationId)


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, lineage is cut, and a lost executor costs no recomputation."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """fmt: parquet or json (a record per line)."""
    return spark.read.schema(schema).format(fmt).load(path)


def unpacked(df: DataFrame) -> DataFrame:
    """File form to scalar form."""
    out = df.withColumnRenamed("timestamp", "ts_s").withColumnRenamed("det_idx", "slot")
    return out.withColumns({c: F.get("bbox", i) for i, c in enumerate(("x1", "y1", "x2", "y2"))}).drop("bbox", "center")


#: Columns whose names in files differ from those inside.
FILE_NAMES = {"ts_s": "timestamp", "slot": "det_idx", "cx": "center_x", "cy": "center_y", "objects": "object_type", "mean_confidence": "confidence"}


def file_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in FILE_NAMES.items() if k in df.columns and v not in df.columns})


def packed(df: DataFrame) -> DataFrame:
    """Scalar form to file form. Detections have a slot, and in files also center, width, height and area."""
    out = df.withColumnsRenamed({"ts_s": "timestamp", "slot": "det_idx"}).withColumn("bbox", F.array("x1", "y1", "x2", "y2"))
    if "slot" in df.columns:
        w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        out = out.withColumns({"center": F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), "width": w, "height": h, "area": w * h})
    return out.drop("x1", "y1", "x2", "y2")


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return unpacked(read_table(spark, path, DETECTIONS, fmt))


def read_tracks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return unpacked(read_table(spark, path, TRACKS, fmt))


def _gathered(df: DataFrame, partition_by: tuple) -> DataFrame:
    """Rows of a folder in few tasks, so that there are about as many files as folders and not as folders times tasks; Spark splits what is too large for one."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple = ()) -> None:
    """fmt: parquet, json or csv; csv gets scalar columns for arrays."""
    if fmt == "csv":
        return export_csv(df, path, partition_by)
    _gathered(df, partition_by).write.format(fmt).partitionBy(*partition_by).save(path)
    return None


def export_csv(df: DataFrame, path: str, partition_by: tuple = ()) -> None:
    """CSV with a header of the names that files have; arrays as columns of their own."""
    df = file_names(df)
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    out = df.withColumns({f"{n}_{i}": F.get(n, i) for n in arrays for i in range(4 if n == "bbox" else 2)}).drop(*arrays)
    _gathered(out, partition_by).write.option("header", True).partitionBy(*partition_by).csv(path)


def export_by_team(tracks: DataFrame, path: str) -> None:
    export_csv(tracks.filter("team_name <> 'unknown'"), path, ("team_name",))


def packed_events(events: DataFrame) -> DataFrame:
    """Events of `all_events` as files have them: location as an array, the fields of both kinds beside each other, null where there is none."""
    have = set(events.columns)
    fields = [f.split(":") for f in EVENTS[EVENTS.index("STRUCT<") + 7 : -1].split(",")]
    return events.select(
        "match_id", "event_type", "frame_idx", F.col("ts_s").alias("timestamp"), "confidence", F.array("x", "y").alias("location"),
        *[F.col(m.strip()) if m.strip() in have else F.lit(None).cast(t.strip()).alias(m.strip()) for m, t in fields])


def write_events(events: DataFrame, path: str) -> None:
    """Events of `all_events` as JSON lines, the fields of each kind under `metadata`."""
    out = packed_events(events)
    own = ["match_id", "event_type", "frame_idx", "timestamp", "confidence", "location"]
    out.select(*own, F.struct(*[c for c in out.columns if c not in own]).alias("metadata")).write.json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(EVENTS).json(path)
    return rows.select("match_id", "event_type", "frame_idx", F.col("timestamp").alias("ts_s"), "confidence", F.get("location", 0).alias("x"), F.get("location", 1).alias("y"), "metadata.*")


def write_documents(docs: DataFrame, path: str) -> None:
    """An indented document per match, each in its match's folder: path/match_id=<id>/."""
    body = F.to_json(F.struct(*[c for c in docs.columns if c != "match_id"]), {"pretty": "true"})
    docs.select("match_id", body.alias("value")).write.partitionBy("match_id").text(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per file, each one document, indented or not. match_id comes from the folder, else from the document, else it is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_score(timeline: DataFrame, path: str) -> None:
    """One document per match from `score_timeline`."""
    item = F.struct(F.col("ts_s").alias("timestamp"), "frame_idx", F.struct("team_a", "team_b").alias("score"), "confidence", "goal_region")
    docs = timeline.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("goals"), F.struct(F.max("team_a").alias("team_a"), F.max("team_b").alias("team_b")).alias("final_score"), F.sort_array(F.collect_list(item)).alias("timeline"))
    write_documents(docs, path)


def read_score(spark: SparkSession, path: str) -> DataFrame:
    rows = read_documents(spark, path, SCORES).select("match_id", F.explode("timeline").alias("t"))
    return rows.select("match_id", F.col("t.timestamp").alias("ts_s"), "t.frame_idx", "t.score.team_a", "t.score.team_b", "t.confidence", "t.goal_region")


def write_teams(teams: DataFrame, track_teams: DataFrame, path: str) -> None:
    """teams: match_id, team_id, team_name, b, g, r; track_teams: match_id, team_id, track_id. One document per match."""
    key = F.col("team_id").cast("string")
    docs = teams.groupBy("match_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_teams"), F.map_from_entries(F.collect_list(F.struct(key, F.array("b", "g", "r")))).alias("team_colors"),
        F.map_from_entries(F.collect_list(F.struct(key, "team_name"))).alias("team_names"))
    who = track_teams.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("string"), key))).alias("track_assignments"))
    write_documents(docs.join(who, "match_id", "left"), path)


def read_teams(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    docs = read_documents(spark, path, TEAMS)
    names = docs.select("match_id", F.explode("team_names").alias("team_id", "team_name"), "team_colors")
    color = F.col("team_colors")[F.col("team_id")]
    teams = names.select("match_id", F.col("team_id").cast("int").alias("team_id"), "team_name", *[F.get(color, i).alias(c) for i, c in enumerate("bgr")])
    who = docs.select("match_id", F.explode("track_assignments").alias("track_id", "team_id"))
    return teams, who.select("match_id", F.col("team_id").cast("int").alias("team_id"), F.col("track_id").cast("long").alias("track_id"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, MATCHES)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """config is the JSON text of the run's settings."""
    return read_documents(spark, path, MANIFEST)
