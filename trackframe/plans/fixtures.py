"""Input tables derived from the driver's tables: each is one SELECT that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_det": """
SELECT match_id, frame_idx, frame_idx / 25.0E0 AS ts_s, slot,
       CASE WHEN slot = 0 THEN 'ball' ELSE 'player' END AS object_type,
       CASE WHEN slot = 0 THEN 32 ELSE 0 END AS class_id,
       cx - hw AS x1, cy - hh AS y1, cx + hw AS x2, cy + hh AS y2,
       0.35E0 + disc * 0.06E0 AS confidence,
       CASE WHEN slot % 2 = 0 THEN 200 ELSE 40 END + (qty % 25) AS b,
       40 + (qty % 11) AS g,
       CASE WHEN slot % 2 = 0 THEN 40 ELSE 200 END + (qty % 25) AS r
FROM (SELECT CAST(FLOOR(l_suppkey / 20.0E0) AS BIGINT) AS match_id, l_suppkey % 20 AS slot, CAST(n AS BIGINT) AS frame_idx,
             CAST(ROUND(l_discount * 100) AS BIGINT) AS disc, CAST(l_quantity AS BIGINT) AS qty,
             CAST(60 + (l_suppkey % 20) * 90 + ABS(((n * 2) % 80) - 40) AS DOUBLE) AS cx,
             CAST(ABS(((n * (2 + l_suppkey % 3) + (l_suppkey % 20) * 37) % 2000) - 1000) + 40 AS DOUBLE) AS cy,
             CASE WHEN l_suppkey % 20 = 0 THEN 8.0E0 ELSE 20.0E0 END AS hw,
             CASE WHEN l_suppkey % 20 = 0 THEN 8.0E0 ELSE 45.0E0 END AS hh
      FROM (SELECT l_suppkey, l_discount, l_quantity,
                   ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS n
            FROM lineitem) a
      ) d
""",
    "fx_ball": """
SELECT match_id, CAST(1 AS BIGINT) AS track_id,
       n + 3 * CAST(FLOOR(n / 16.0E0) AS BIGINT) AS frame_idx,
       (n + 3 * CAST(FLOOR(n / 16.0E0) AS BIGINT)) / 25.0E0 AS ts_s,
       CAST(960 + (k - 50) * 3 AS DOUBLE) AS cx,
       CAST(ABS(((n * (17 + (match_id * 7) % 28)) % 2160) - 1080) AS DOUBLE) AS cy,
       0.5E0 + k / 200.0E0 AS confidence
FROM (SELECT match_id, k, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY event_id) - 1 AS n
      FROM (SELECT CAST(FLOOR(user_id / 30.0E0) AS BIGINT) AS match_id, event_id,
                   CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS k
            FROM events) a) e
""",
    "fx_match": """
SELECT CAST(FLOOR(user_id / 30.0E0) AS BIGINT) AS match_id, 25.0E0 AS fps,
       COUNT(*) + 3 * CAST(FLOOR((COUNT(*) - 1) / 16.0E0) AS BIGINT) AS total_frames,
       1920 AS width, 1080 AS height,
       (COUNT(*) + 3 * CAST(FLOOR((COUNT(*) - 1) / 16.0E0) AS BIGINT)) / 25.0E0 AS duration
FROM events GROUP BY CAST(FLOOR(user_id / 30.0E0) AS BIGINT)
""",
    "fx_trk": """
SELECT match_id, match_id * 100 + slot AS track_id, frame_idx, ts_s, object_type, x1, y1, x2, y2, confidence,
       frame_idx AS age, frame_idx + 1 AS hits, CAST(0 AS BIGINT) AS time_since_update,
       CASE WHEN slot = 0 OR slot % 7 = 6 THEN -1 ELSE slot % 2 END AS team_id,
       CASE WHEN slot = 0 OR slot % 7 = 6 THEN 'unknown' WHEN slot % 2 = 0 THEN 'team_A' ELSE 'team_B' END AS team_name
FROM fx_det WHERE frame_idx < 8 + ((slot + match_id * 7) % 20) * 37
""",
    "fx_evt": """
SELECT match_id, CASE WHEN event_type = 'purchase' THEN 'goal' ELSE 'shot' END AS event_type,
       n AS frame_idx, n / 25.0E0 AS ts_s, k / 100.0E0 AS confidence,
       CASE WHEN k % 2 = 0 THEN 'top' ELSE 'bottom' END AS region, value AS speed
FROM (SELECT match_id, event_type, value, k,
             CAST(40 * (ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY event_id) - 1) AS BIGINT) AS n
      FROM (SELECT CAST(FLOOR(user_id / 30.0E0) AS BIGINT) AS match_id, event_id, event_type, value,
                   CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS k
            FROM events) a) e
""",
    "fx_pixel": """
SELECT CAST(FLOOR(p / 400.0E0) AS BIGINT) AS frame_idx, p % 20 AS x, CAST(FLOOR((p % 400) / 20.0E0) AS BIGINT) AS y,
       sz * 5 AS b, (sz * 7) % 256 AS g, (sz * 11) % 256 AS r
FROM (SELECT p_partkey - (SELECT MIN(p_partkey) FROM part) AS p, CAST(p_size AS BIGINT) AS sz FROM part) q
""",
    "fx_box": """
SELECT s_suppkey AS box_id, s_suppkey % 5 AS frame_idx, s_suppkey % 11 AS x1, s_suppkey % 7 AS y1,
       s_suppkey % 11 + 4 + s_suppkey % 6 AS x2, s_suppkey % 7 + 5 + s_suppkey % 9 AS y2
FROM supplier
""",
}
TABLES = {"fx_det": ["lineitem"], "fx_ball": ["events"], "fx_match": ["events"], "fx_trk": ["lineitem"], "fx_evt": ["events"], "fx_pixel": ["part"], "fx_box": ["supplier"]}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    if name == "fx_trk":
        fx(spark, sf_dir, "fx_det").createOrReplaceTempView("fx_det")
    return spark.sql(FIXTURES[name])


def with_fixtures(sql: str) -> str:
    """sql with the fixtures it names as common table expressions."""
    names = [n for n in FIXTURES if n in sql]
    if "fx_trk" in names and "fx_det" not in names:
        names.insert(0, "fx_det")
    own = sql.strip()
    head = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {own[14:]}"
    return f"WITH {head}, {own[4:]}" if own.upper().startswith("WITH") else f"WITH {head} {own}"
