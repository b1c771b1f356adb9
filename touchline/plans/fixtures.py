"""Views over the given tables that give every operator a deterministic input at any size."""

from pyspark.sql import DataFrame, SparkSession

OBJECTS = """
WITH base AS (
 SELECT l_suppkey AS obj_id, l_suppkey % 5 AS match_id, l_suppkey % 10 AS clip_id, l_partkey, l_orderkey, l_linenumber, l_returnflag,
  ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
 FROM {lineitem}),
f AS (
 SELECT *, rn + 3 * CAST(FLOOR(rn / 10e0) AS BIGINT) + 40 * CAST(FLOOR(rn / 75e0) AS BIGINT) + obj_id % 7 AS frame,
  200e0 + 1e0 * ((obj_id * 173) % 1400) + 1e0 * ABS((rn * (1 + obj_id % 4)) % 240 - 120) + 1e0 * (l_partkey % 3)
    + CASE WHEN l_orderkey % 97 = 0 THEN 600e0 ELSE 0e0 END AS cx,
  300e0 + 1e0 * ((obj_id * 37) % 600) + 1e0 * (l_partkey % 5) AS cy
 FROM base),
g AS (SELECT *, 20e0 + 8e-2 * cy + 4e0 * (obj_id % 9 - 4) + 1e0 * (l_linenumber % 3 - 1) AS h FROM f)
SELECT match_id, clip_id, obj_id, frame, cx - 2e-1 * h AS x1, cy - 5e-1 * h AS y1, cx + 2e-1 * h AS x2, cy + 5e-1 * h AS y2,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'unsure' WHEN obj_id % 3 = 0 THEN 'opp' ELSE 'home' END AS team,
  3e-1 + (l_partkey % 70) / 100e0 AS conf,
  CASE WHEN l_linenumber = 1 AND obj_id % 2 = 0 THEN CAST(1 + obj_id % 30 AS VARCHAR(2)) ELSE '' END AS number,
  CASE rn % 4 WHEN 0 THEN 'detection' WHEN 1 THEN 'csrt' WHEN 2 THEN 'manual' ELSE 'sam2' END AS source
FROM g"""

PIXELS = """SELECT l_suppkey AS obj_id, l_orderkey AS frame, CASE WHEN l_linenumber % 2 = 0 THEN 'torso' ELSE 'shorts' END AS region,
 l_partkey % 180 AS h, (l_partkey * 7) % 256 AS s, (l_suppkey * 13 + l_linenumber * 29) % 256 AS v FROM {lineitem}"""

POSE = """SELECT l_suppkey % 10 AS clip_id, l_orderkey AS frame, l_linenumber AS kp, MIN((l_partkey % 1000) / 1000e0) AS x,
 MIN((l_suppkey % 100) / 100e0) AS y, MIN((l_partkey % 11) / 10e0) AS vis
FROM {lineitem} GROUP BY l_suppkey % 10, l_orderkey, l_linenumber"""

FRAME_W, FRAME_H, FPS = 1920.0, 1080.0, 30.0
HOMOGRAPHY = (0.05, 0.002, -3.0, 0.001, 0.06, -2.0, 1e-4, 2e-4, 1.0)


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OBJECTS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PIXELS)


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, POSE)


def sql(body: str, **views: str) -> str:
    """DuckDB text: the fixture views, further views by name, then the query."""
    parts = [f"{name} AS ({text})" for name, text in {"objects_v": OBJECTS, "pixel_v": PIXELS, "pose_v": POSE}.items() if name in body + "".join(views.values())]
    parts += [f"{name} AS ({text})" for name, text in views.items()]
    return ("WITH " + ", ".join(parts) + " " + body).replace("{lineitem}", "lineitem")
