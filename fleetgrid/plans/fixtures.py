"""Frames, points, boxes, labels, catalogue rows and results derived from general-purpose tables, for queries and tests.

Whole-number arithmetic first and one division last, so that any engine gets the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..grid import FRAME

DATASET = "driver"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(of: str) -> list[str]:
    return [f"'{DATASET}' AS dataset", f"cast({of} % 5 AS string) AS scene_id", f"cast({of} div 5 AS int) AS frame_idx"]


def points(spark: SparkSession, sf_dir: str, coarse: bool = False, dense: bool = False) -> DataFrame:
    """One point a row of lineitem, in sensor axes. ``coarse`` moves them to few places, so that cells are hit often; ``dense`` gives
    them all to nine frames, so that these have as many points as a real scan or more."""
    xyz = (
        "((l_partkey * 7919 + l_linenumber * 1543 + l_orderkey * 31) % 5000 - 2500) / 100D AS x",
        "((l_orderkey * 6007 + l_linenumber * 977 + l_partkey * 17) % 5000 - 2500) / 100D AS y",
        "((l_orderkey * 101 + l_partkey * 13 + l_linenumber * 7) % 600 - 250) / 100D AS z",
    )
    # unpacked from a struct, so that each number is worked out once, not again in every filter that Spark moves down to here
    out = _read(spark, sf_dir, "lineitem").selectExpr(*_frame("(1 + l_suppkey % 9)" if dense else "l_suppkey"), f"inline(array(struct({', '.join(xyz)})))")
    return out.withColumns({c: F.floor(c) + 0.25 for c in "xy"}) if coarse else out


def _about_z(u: str) -> F.Column:
    """A rational unit quaternion about the vertical axis."""
    return F.expr(f"array((1 - {u} * {u}) / (1 + {u} * {u}), 0D, 0D, 2 * {u} / (1 + {u} * {u}))")


def frames(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """A frame for each supplier, five scenes. ``turned`` turns the sensor on the vehicle."""
    base = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey", *_frame("s_suppkey"))
    base = base.withColumns({"calib_q": _about_z("((s_suppkey % 7) / 20D)" if turned else "0D"), "pose_q": _about_z("((frame_idx % 11) / 40D)")})
    return base.select(
        *FRAME,
        "calib_q",
        "pose_q",
        g.quat_to_matrix(F.col("calib_q")).alias("calib_r"),
        F.expr("array(0D, 0D, 1.84D)").alias("calib_t"),
        g.quat_to_matrix(F.col("pose_q")).alias("pose_r"),
        F.expr("array(1000D * cast(scene_id AS int) + 8 * frame_idx / 10D, 3 * frame_idx / 10D, 0D)").alias("pose_t"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order, in world coordinates, around the frame of its customer."""
    n = _read(spark, sf_dir, "supplier").count()
    out = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS box_id",
        *_frame(f"(o_custkey % {n})"),
        "((o_orderkey * 37) % 4400 - 2200) / 100D AS dx",
        "((o_custkey * 53 + o_orderkey * 11) % 4400 - 2200) / 100D AS dy",
        "1.5D + (o_orderkey % 5) / 4D AS w",
        "3D + (o_orderkey % 7) / 2D AS l",
        "(o_orderkey % 9) / 10D AS u",
    )
    out = out.withColumn("q", _about_z("u")).withColumn("yaw", g.yaw_of(F.col("q")))
    placed = out.join(frames(spark, sf_dir).select(*FRAME, "pose_t"), FRAME)
    return placed.select(*FRAME, "box_id", (F.col("pose_t")[0] + F.col("dx")).alias("cx"), (F.col("pose_t")[1] + F.col("dy")).alias("cy"), "w", "l", "yaw", "q")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera-coordinate labels with a calibration, for the camera-based frames. One frame in seven has all its labels far away."""
    n = _read(spark, sf_dir, "supplier").count()
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS box_id",
        *_frame(f"(o_custkey % {n})"),
        f"((o_orderkey * 37) % 4400 - 2200) / 100D + if(o_custkey % {n} % 7 = 3, 100D, 0D) AS x",
        "1.65D AS y",
        "((o_custkey * 53 + o_orderkey * 11) % 4400 - 2200) / 100D AS z",
        "1.5D + (o_orderkey % 5) / 4D AS w",
        "3D + (o_orderkey % 7) / 2D AS l",
        "((o_orderkey * 29) % 600 - 300) / 100D AS rotation_y",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by frame and method, one row each, some missing; two datasets."""
    n = _read(spark, sf_dir, "supplier").count()
    rows = _read(spark, sf_dir, "orders").selectExpr(
        f"o_custkey % {n} AS f",
        "o_orderkey % 3 AS m",
        "if(o_orderkey % 17 = 0, NULL, (o_orderkey * 37 % 1000) / 1000D) AS nmse",
        "if(o_orderkey % 13 = 0, NULL, (o_orderkey * 53 % 1000) / 2000D) AS iobb",
        "if(o_orderkey % 11 = 0, NULL, (o_orderkey * 71 % 1000) / 4000D) AS precision",
        "cast(o_orderkey * 7 % 150 AS int) AS iters",
        "(o_orderkey * 13 % 900 + 100) / 100D AS elapsed_s",
    )
    one = rows.groupBy("f", "m").agg(*(F.min(c).alias(c) for c in ("nmse", "iobb", "precision", "iters", "elapsed_s")))
    return one.selectExpr(
        "if(f % 2 = 0, 'a', 'b') AS dataset", "cast(f % 5 AS string) AS scene_id", "cast(f div 5 AS int) AS frame_idx",
        "element_at(array('t1', 't2_beta0', 't2_beta1'), cast(m + 1 AS int)) AS method", "cast(if(m = 2, 1, 0) AS int) AS beta", "nmse", "iobb", "precision", "iters", "iters < 60 AS converged", "elapsed_s",
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of scenes: a scene for each nation, its samples linked from the first to the last supplier."""
    s = _read(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("scene")).agg(F.count("*").alias("nbr_samples"), F.min("s_suppkey").alias("first")).selectExpr(
        "concat('scene-', scene) AS name", "concat('s', scene) AS token", "cast(nbr_samples AS int) AS nbr_samples", "concat('m', first) AS first_sample_token", "'' AS description"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    link = "lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)"
    return s.selectExpr("concat('m', s_suppkey) AS token", "concat('s', s_nationkey) AS scene_token", f"coalesce(concat('m', {link}), '') AS next", "1000 * s_suppkey AS timestamp")


def sample_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor files of each sample: one of the roof sensor, one of a camera, and sweeps that are no key frames."""
    s = _read(spark, sf_dir, "supplier")
    files = "explode(array(struct('LIDAR_TOP' AS kind, true AS is_key_frame), struct('CAM_FRONT' AS kind, true AS is_key_frame), struct('LIDAR_TOP' AS kind, false AS is_key_frame))) AS d"
    rows = s.selectExpr("s_suppkey", files)
    return rows.selectExpr(
        "concat('d', s_suppkey, d.kind, d.is_key_frame) AS token", "concat('m', s_suppkey) AS sample_token", "concat('samples/', d.kind, '/', s_suppkey, '.bin') AS filename", "d.is_key_frame AS is_key_frame",
        "concat('p', s_suppkey) AS ego_pose_token", "concat('c', s_suppkey % 4) AS calibrated_sensor_token",
    )


def _file(spark: SparkSession, sf_dir: str, *lines: str) -> DataFrame:
    """``path, n, line``: a text file for each order, with the lines that the expressions give (``k``: its key)."""
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")
    numbered = F.posexplode(F.array(*(F.expr(x) for x in lines))).alias("n", "line")
    return orders.select(F.concat(F.lit("file/"), "k").alias("path"), "k", numbered).select("path", "n", F.trim("line").alias("line"))


def _row(first: str, n: int) -> str:
    """n numbers that go up by one, as text."""
    return f"array_join(transform(sequence(0, {n - 1}), i -> concat({first} + i, '.25')), ' ')"


def calib_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration files: a line without a colon, an empty one, the sensor matrix under one of three names, a name that is repeated."""
    sensor = f"concat(element_at(array('Tr', 'Tr_velo_to_cam', 'Tr_velo_cam'), cast(k % 3 + 1 AS int)), ': ', {_row('k % 83', 12)})"
    again = f"if(k % 5 = 0, concat('P0:', {_row('k % 71', 12)}), 'no colon')"
    return _file(spark, sf_dir, f"concat('P0: ', {_row('k % 97', 12)}, '  ')", "'no colon here'", f"concat('R0_rect: ', {_row('k % 89', 9)})", sensor, again, "''")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files: eight classes, one that readers skip and one that some skip; lines a field short, heights that are no number."""
    kind = "element_at(array('Car', 'Van', 'Truck', 'Pedestrian', 'Cyclist', 'Tram', 'DontCare', 'Misc'), cast(k % 8 + 1 AS int))"
    height, turn = "if(k % 13 = 0, 'x', concat(1 + k % 3, '.5'))", "if(k % 11 = 0, '', concat(' ', k % 4 - 2, '.5'))"
    one = f"concat({kind}, ' 0 0 0 1 2 3 4 ', {height}, ' 1.75 ', 3 + k % 2, ' ', k % 40 - 20, '.25 1.7 ', k % 50, turned)"
    return _file(spark, sf_dir, one.replace("turned", turn), "''", "concat('Car 0 0 0 1 2 3 4 1.5 1.75 4 ', k % 7, '.5 1.7  20 0')")


def pose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose files: between three positions an empty line, one a number short, and one with a word in it."""
    return _file(spark, sf_dir, _row("k % 97", 12), "''", _row("k % 97", 11), _row("k % 89", 12), f"concat('x ', {_row('k', 11)})", _row("k % 83", 12))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: a binary scan for each supplier, five little-endian float32 numbers a point, all quarters of whole numbers."""

    def float32(k: str) -> str:
        places = f"(length(bin(abs({k}))) - 1)"
        bits = f"if({k} = 0, 0L, if({k} < 0, 2147483648L, 0L) + shiftleft(125L + {places}, 23) + shiftleft(cast(abs({k}) AS bigint), 23 - {places}) - 8388608L)"
        big = f"lpad(hex({bits}), 8, '0')"
        return f"concat(substr({big}, 7, 2), substr({big}, 5, 2), substr({big}, 3, 2), substr({big}, 1, 2))"

    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_suppkey", *QUARTERS)
    rows = rows.selectExpr("l_suppkey", "struct(kx, ky, kz, ki, kr) AS place", f"concat({', '.join(float32(k) for k in ('kx', 'ky', 'kz', 'ki', 'kr'))}) AS record")
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda p: p["record"]), "")
    return rows.groupBy("l_suppkey").agg(F.unhex(one).alias("content")).select(F.concat(F.lit("scan/"), "l_suppkey").alias("path"), "content")


#: Four times the numbers of a scanned point, in any engine.
QUARTERS = (
    "(l_partkey * 7919 + l_linenumber * 1543 + l_orderkey * 31) % 5000 - 2500 AS kx",
    "(l_orderkey * 6007 + l_linenumber * 977 + l_partkey * 17) % 5000 - 2500 AS ky",
    "(l_orderkey * 101 + l_partkey * 13 + l_linenumber * 7) % 600 - 250 AS kz",
    "l_partkey % 256 AS ki",
    "l_linenumber * 4 AS kr",
)


def metadata(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Writes the catalogue's tables as files of JSON arrays, one for each scene or residue of a key."""
    pose = frames(spark, sf_dir).selectExpr("concat('p', cast(scene_id AS int) + 5 * frame_idx) AS token", "pose_t AS translation", "pose_q AS rotation", "scene_id AS part")
    sensor = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey % 4 AS part").distinct().selectExpr("concat('c', part) AS token", "array(0D, 0D, part * 0.5D) AS translation", "array(1D, 0D, 0D, 0D) AS rotation", "part")
    boxed = boxes(spark, sf_dir).selectExpr("concat('a', box_id) AS token", "concat('m', cast(scene_id AS int) + 5 * frame_idx) AS sample_token", "array(cx, cy, 0D) AS translation", "array(w, l, 1.5D) AS size", "q AS rotation", "concat(scene_id, '-', frame_idx) AS part")
    tables = {
        "scene": scenes(spark, sf_dir).withColumn("part", F.col("token")),
        "sample": samples(spark, sf_dir).withColumn("part", F.col("scene_token")),
        "sample_data": sample_data(spark, sf_dir).withColumn("part", F.substring_index("filename", "/", -1)),
        "ego_pose": pose,
        "calibrated_sensor": sensor,
        "sample_annotation": boxed,
    }
    for name, rows in tables.items():
        own = F.struct(*(c for c in rows.columns if c != "part"))
        array = rows.groupBy(F.pmod(F.xxhash64("part"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(own)).alias("value"))
        array.repartition("part").write.partitionBy("part").text(f"{root}/{name}.json")
