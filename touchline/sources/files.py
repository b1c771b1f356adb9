"""Readers and writers of the file formats, tolerant where the formats are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import role

# The formats' columns.
DETECTIONS = "frame int, x1 double, y1 double, x2 double, y2 double, conf double, team_score double, kept boolean"
TRACK_COLUMNS = ("frame", "target_id", "x1", "y1", "x2", "y2", "source", "confidence")
OBJECT_COLUMNS = ("frame", "obj_id", "x1", "y1", "x2", "y2", "team", "conf", "number")
V1_COLUMNS = ("frame", "track_id", "x1", "y1", "x2", "y2", "confidence")
MEDIA = ("mp4", "mov", "avi", "mkv", "m4v")


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def _whole(name: str) -> Column:
    """Whole numbers written as '3' or '3.0'."""
    return F.floor(_number(name)).cast("int")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Parquet detections in column order; missing columns are 0, but kept null: no gate has run. Partition columns (match_id, clip_id) stay."""
    raw = spark.read.parquet(path)
    have = set(raw.columns)
    own = [part.split() for part in DETECTIONS.split(", ")]
    cols = [(F.col(n) if n in have else F.lit(None if n == "kept" else 0)).cast(kind).alias(n) for n, kind in own]
    return raw.select(*[c for c in raw.columns if c not in {n for n, _ in own}], *cols)


def write_detections(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("match_id").parquet(path)


def _text(spark: SparkSession, path: str, columns) -> DataFrame:
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns], F.col("_metadata.file_path").alias("file_path"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """CSV tracks; a confidence that is absent, blank or bad is 1.0."""
    raw = _text(spark, path, TRACK_COLUMNS)
    return raw.select("file_path", _whole("frame").alias("frame"), _whole("target_id").alias("target_id"), *[_number(c).alias(c) for c in ("x1", "y1", "x2", "y2")], "source", F.coalesce(_number("confidence"), F.lit(1.0)).alias("confidence"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """CSV objects; rows whose frame, id or box don't parse are left out, a bad confidence is 0."""
    raw = _text(spark, path, OBJECT_COLUMNS)
    rows = raw.select("file_path", _whole("frame").alias("frame"), _whole("obj_id").alias("obj_id"), *[_number(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce("team", F.lit("")).alias("team"), F.coalesce(_number("conf"), F.lit(0.0)).alias("conf"), F.coalesce("number", F.lit("")).alias("number"))
    return rows.dropna(subset=["frame", "obj_id", "x1", "y1", "x2", "y2"])


def read_v1_tracks(spark: SparkSession, path: str) -> DataFrame:
    raw = _text(spark, path, V1_COLUMNS)
    return raw.select("file_path", _whole("frame").alias("frame"), _whole("track_id").alias("target_id"), *[_number(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce(_number("confidence"), F.lit(1.0)).alias("confidence"))


def _fixed(name: str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.col(name).cast("double")).alias(name)


def write_tracks(rows: DataFrame, path: str, keys=("match_id", "clip_id")) -> None:
    """CSV tracks by clip, ordered by frame inside each file; boxes with two places, confidence with three."""
    out = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).repartition(*keys).sortWithinPartitions(*keys, "frame", "target_id")
    text = out.select(*keys, F.col("frame").cast("string"), F.col("target_id").cast("string"), *[_fixed(c, 2) for c in ("x1", "y1", "x2", "y2")], "source", _fixed("confidence", 3))
    text.write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


def write_v1_tracks(rows: DataFrame, path: str, keys=("match_id", "clip_id")) -> None:
    out = rows.repartition(*keys).sortWithinPartitions(*keys, "frame", "track_id")
    out.select(*keys, "frame", "track_id", *[_fixed(c, 2) for c in ("x1", "y1", "x2", "y2")], _fixed("confidence", 4)).write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


BAND = "struct<lo:array<double>,hi:array<double>>"
CALIBRATION = f"video string, teams array<struct<name:string,track:boolean,n_samples:int,primary:{BAND},secondary:{BAND},shorts:{BAND},height:struct<a:double,b:double,resid_std:double,y_min:double,y_max:double>,fingerprint:array<double>>>"


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """One row per file and team: name, track, n_samples, the colour bands (lo and hi of h, s, v), height model and fingerprint; what a file lacks is null."""
    raw = spark.read.schema(CALIBRATION).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), "video", F.explode("teams").alias("t")).select("file_path", "video", "t.*")


def read_pitch(spark: SparkSession, path: str) -> DataFrame:
    """h11..h33 and anchor frame of each file with a usable matrix; broken, missing or degenerate ones give no row."""
    raw = spark.read.schema("H array<array<double>>, anchor_frame int, reproj_error double").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    cells = {f"h{i + 1}{k + 1}": F.get(F.get("H", F.lit(i)), F.lit(k)) for i in range(3) for k in range(3)}
    out = raw.select(F.col("_metadata.file_path").alias("file_path"), "anchor_frame", "reproj_error", *[c.alias(n) for n, c in cells.items()]).dropna(subset=list(cells))
    h = {n: F.col(n) for n in cells}
    det = h["h11"] * (h["h22"] * h["h33"] - h["h23"] * h["h32"]) - h["h12"] * (h["h21"] * h["h33"] - h["h23"] * h["h31"]) + h["h13"] * (h["h21"] * h["h32"] - h["h22"] * h["h31"])
    finite = F.lit(True)
    for c in h.values():
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.where(finite & (F.abs(det) > 1e-12))


def clip_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Media files under a folder: key (file stem), player (the part before '__', if any), path, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)
    media = files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*MEDIA))
    keyed = media.select(stem.alias("key"), "path", "bytes").withColumn("player", F.when(F.col("key").contains("__"), F.substring_index("key", "__", 1)))
    return keyed.groupBy("key", "player").agg(F.min_by(F.struct("path", "bytes"), "path").alias("f")).select("key", "player", "f.path", "f.bytes")


def write_player_stats(stats: DataFrame, path: str) -> None:
    """The stats report as CSV, farthest first."""
    cols = ("obj_id", "team", "distance_m", "top_speed_ms", "avg_speed_ms", "minutes", "n_frames")
    stats.orderBy(F.desc("distance_m"), "obj_id").select("match_id", "clip_id", *cols).write.mode("overwrite").option("header", True).csv(path)


def write_export_stats(report: DataFrame, path: str) -> None:
    """The export report (``export_report``) as JSON lines, one a track, in order inside each match's file."""
    report.repartition("match_id").sortWithinPartitions("match_id", "clip_id", "obj_id").write.mode("overwrite").partitionBy("match_id").json(path)


def write_ruleout_seed(seed: DataFrame, me: DataFrame, path: str, keys=("match_id",)) -> None:
    """One JSON object by keys: my_number, my_role and rule_out, the players that are not me in their order (place).

    seed: keys, place and what tells each player (``ruled_out_seed``, ``rule_out``). me: keys, my_number. Nobody to rule out gives an empty list.
    """
    told = [c for c in seed.columns if c not in (*keys, "place")]
    others = seed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*told).alias("player")))), lambda s: s["player"]).alias("rule_out"))
    out = me.select(*keys, "my_number").join(others, list(keys), "left").withColumn("my_role", role(F.col("my_number"))[0])
    empty = F.array().cast(others.schema["rule_out"].dataType)
    out.select(*keys, "my_number", "my_role", F.coalesce("rule_out", empty).alias("rule_out")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Profiles, stats or rule-out seeds as JSON lines."""
    rows.write.mode("overwrite").json(path)
