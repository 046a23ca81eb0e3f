"""Every operator as a query over the given tables, most with SQL of another engine for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.rays import ray
from ..grid import CELL, FRAME, Grid
from ..operators import boxes as bx
from ..operators import catalog, metrics, preprocess, reports, tier1, tier2
from ..operators.solver import Settings
from ..sources import readers
from ..sources.shared import new_folder
from . import fixtures as fx
from .oracle import HIGH_OK, K, RANGE_OK, coarse_hits, fold, solved, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return (F.round(c.cast("double"), 6) + 0.0).alias(alias or name)


def fast6(name: str, alias: str | None = None) -> Column:
    """As r6, for columns of very many rows: in floating point, as DuckDB rounds, where Spark's round() makes a decimal number for each row."""
    return (F.rint(F.col(name) * 1e6) / 1e6 + 0.0).alias(alias or name)


def _kept(spark: SparkSession, d: str, coarse: bool = False) -> DataFrame:
    return preprocess.preprocess(fx.points(spark, d, coarse), fx.frames(spark, d))


def _map(spark: SparkSession, d: str, coarse: bool = False, merged: bool = False) -> DataFrame:
    return tier1.single_scan_map(_kept(spark, d, coarse), merged=merged)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return bx.to_ego_offset(fx.boxes(spark, d), fx.frames(spark, d))


# --- geometry


@query(sql(f"SELECT {K}, round(r00, 6) + 0.0 AS r00, round(r01, 6) + 0.0 AS r01, round(r10, 6) + 0.0 AS r10, 1.0::DOUBLE AS r22, round(pw, 6) + 0.0 AS qw, round(pz, 6) + 0.0 AS qz FROM frm", "frm"))
def p1_quat_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = fx.frames(spark, d).withColumn("q", g.matrix_to_quat(F.col("pose_r")))
    r = F.col("pose_r")
    return f.select(*FRAME, r6(r[0], "r00"), r6(r[1], "r01"), r6(r[3], "r10"), r6(r[8], "r22"), r6(F.col("q")[0], "qw"), r6(F.col("q")[3], "qz"))


@query(sql(f"SELECT {K}, round(x::DOUBLE, 6) + 0.0 AS x, round(y::DOUBLE, 6) + 0.0 AS y, round(z::DOUBLE, 6) + 0.0 AS z FROM turned", "turned"))
def p2_to_ego(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.transform_to_ego(fx.points(spark, d), fx.frames(spark, d, turned=True)).select(*FRAME, r6("x"), r6("y"), r6("z"))


@query(sql(f"SELECT {K}, round(r00, 6) + 0.0 AS r0, round(0.0::DOUBLE, 6) AS r3, round(-r10, 6) + 0.0 AS r6, round(-r11, 6) + 0.0 AS r7, round(px, 6) + 0.0 AS t0, 0.5::DOUBLE AS t1, round(-py, 6) + 0.0 AS t2 FROM frm", "frm"))
def p3_camera_calibration(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("pose_r"), F.col("pose_t")
    tr = F.array(p[0], p[1], p[2], t[0], p[3], p[4], p[5], t[1], p[6], p[7], p[8], F.lit(0.5))
    r, t = g.camera_calibration(tr)
    out = fx.frames(spark, d).select(*FRAME, r.alias("r"), t.alias("t"))
    return out.select(*FRAME, *(r6(F.col("r")[i], f"r{i}") for i in (0, 3, 6, 7)), *(r6(F.col("t")[i], f"t{i}") for i in range(3)))


@query(sql(f"SELECT {K}, round(r00, 6) + 0.0 AS r0, round(-r01, 6) + 0.0 AS r2, round(r10, 6) + 0.0 AS r3, round(-r11, 6) + 0.0 AS r5, 1.0::DOUBLE AS r7, round(px, 6) + 0.0 AS t0, round(py, 6) + 0.0 AS t1, 0.5::DOUBLE AS t2 FROM frm", "frm"))
def p4_camera_pose(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("pose_r"), F.col("pose_t")
    m = F.array(p[0], p[1], p[2], t[0], p[3], p[4], p[5], t[1], p[6], p[7], p[8], F.lit(0.5))
    r, t = g.camera_pose(m)
    out = fx.frames(spark, d).select(*FRAME, r.alias("r"), t.alias("t"))
    return out.select(*FRAME, *(r6(F.col("r")[i], f"r{i}") for i in (0, 2, 3, 5, 7)), *(r6(F.col("t")[i], f"t{i}") for i in range(3)))


@query(sql(f"SELECT {K}, count(*) FILTER (z >= 0.3::FLOAT) AS n_above, count(*) FILTER ({HIGH_OK}) AS n_high, count(*) FILTER ({RANGE_OK}) AS n_range FROM ego GROUP BY ALL", "ego"))
def p5_p6_p7_filters(spark: SparkSession, d: str) -> DataFrame:
    ego = preprocess.transform_to_ego(fx.points(spark, d), fx.frames(spark, d))
    x, y, z = (F.col(c) for c in "xyz")
    return ego.groupBy(*FRAME).agg(F.count_if(g.above_ground(z)).alias("n_above"), F.count_if(g.height_ok(z)).alias("n_high"), F.count_if(g.range_ok(x, y, Grid())).alias("n_range"))


@query(sql(f"SELECT {K}, round(x::DOUBLE, 6) + 0.0 AS x, round(y::DOUBLE, 6) + 0.0 AS y, row, col FROM kept_turned", "kept_turned"))
def p10_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.preprocess(fx.points(spark, d), fx.frames(spark, d, turned=True)).select(*FRAME, r6("x"), r6("y"), *CELL)


@query(sql(f"SELECT {K}, off AS \"offset\", row, col, count(*) AS n FROM window_kept GROUP BY ALL", "window_kept"))
def p11_ego_to_ego(spark: SparkSession, d: str) -> DataFrame:
    return tier1.window_points(fx.points(spark, d), fx.frames(spark, d), 2).groupBy(*FRAME, "offset", *CELL).agg(F.count("*").alias("n"))


@query(sql(f"SELECT {K}, er AS ego_row, ec AS ego_col, row, col, count(*) AS n FROM world GROUP BY ALL", "world"))
def p12_world_offset(spark: SparkSession, d: str) -> DataFrame:
    return tier1.world_cells(_kept(spark, d), fx.frames(spark, d)).groupBy(*FRAME, "ego_row", "ego_col", *CELL).agg(F.count("*").alias("n"))


@query(
    sql(
        f"""SELECT {K}, box_id, round(z + 0.1, 6) + 0.0 AS cx, round(-x - 0.2, 6) + 0.0 AS cy, round(-1.65 + 0.3 + 1.73, 6) + 0.0 AS cz,
        round(sin(atan2(-sin(rotation_y), cos(rotation_y))), 6) + 0.0 AS sin_yaw, round(cos(atan2(-sin(rotation_y), cos(rotation_y))), 6) + 0.0 AS cos_yaw FROM labels""",
        "labels",
    )
)
def p13_label_to_ego(spark: SparkSession, d: str) -> DataFrame:
    # sensor (forward, left, up) to camera (right, down, forward), with a small shift
    tr = F.array(*(F.lit(float(v)) for v in (0, -1, 0, -0.2, 0, 0, -1, 0.3, 1, 0, 0, -0.1)))
    centre, yaw = g.label_to_ego([F.col("x"), F.col("y"), F.col("z")], F.col("rotation_y"), g.IDENTITY, tr)
    out = fx.labels(spark, d).withColumns({"cx": centre[0], "cy": centre[1], "cz": centre[2], "yaw": yaw})
    return out.select(*FRAME, "box_id", r6("cx"), r6("cy"), r6("cz"), r6(F.sin("yaw"), "sin_yaw"), r6(F.cos("yaw"), "cos_yaw"))


@query(
    sql(
        f"""SELECT {K}, box_id, round(z + 0.1, 6) + 0.0 AS cx, round(-(0.8 * x + 0.6 * 1.65 + 0.2), 6) + 0.0 AS cy, round(-(-0.6 * x + 0.8 * 1.65 - 0.3) + 1.73, 6) + 0.0 AS cz,
        round(sin(atan2(-0.8 * sin(rotation_y), cos(rotation_y))), 6) + 0.0 AS sin_yaw, round(cos(atan2(-0.8 * sin(rotation_y), cos(rotation_y))), 6) + 0.0 AS cos_yaw FROM labels""",
        "labels",
    )
)
def p13_rectified_label(spark: SparkSession, d: str) -> DataFrame:
    """As p13_label_to_ego, with a rectifying rotation about the camera's axis."""
    tr = F.array(*(F.lit(float(v)) for v in (0, -1, 0, -0.2, 0, 0, -1, 0.3, 1, 0, 0, -0.1)))
    r0 = (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)
    centre, yaw = g.label_to_ego([F.col("x"), F.col("y"), F.col("z")], F.col("rotation_y"), r0, tr)
    out = fx.labels(spark, d).withColumns({"cx": centre[0], "cy": centre[1], "cz": centre[2], "yaw": yaw})
    return out.select(*FRAME, "box_id", r6("cx"), r6("cy"), r6("cz"), r6(F.sin("yaw"), "sin_yaw"), r6(F.cos("yaw"), "cos_yaw"))


@query(
    sql(
        f"""SELECT {K}, box_id, i::INT AS corner, round(cos(yaw) * (a * l) - sin(yaw) * (b * w) + cx, 6) + 0.0 AS x, round(sin(yaw) * (a * l) + cos(yaw) * (b * w) + cy, 6) + 0.0 AS y
        FROM box, (VALUES (0, 0.5, 0.5), (1, 0.5, -0.5), (2, -0.5, -0.5), (3, -0.5, 0.5)) v(i, a, b)""",
        "box",
    )
)
def p14_box_corners(spark: SparkSession, d: str) -> DataFrame:
    out = bx.box_corners(_boxes(spark, d)).select(*FRAME, "box_id", F.posexplode("corners").alias("corner", "c"))
    return out.select(*FRAME, "box_id", "corner", r6("c.x", "x"), r6("c.y", "y"))


@query(sql(f"SELECT {K}, box_id, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(yaw, 6) + 0.0 AS yaw FROM kbox", "kbox"))
def p15_camera_boxes(spark: SparkSession, d: str) -> DataFrame:
    return bx.camera_boxes(fx.labels(spark, d)).select(*FRAME, "box_id", r6("cx"), r6("cy"), r6("yaw"))


@query(sql(f"SELECT {K}, bin, round(d, 6) AS d FROM seen", "seen"))
def p16_angular_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.seen_ranges(_kept(spark, d)).select(*FRAME, "bin", r6("d"))


@query(
    sql(
        f"""SELECT {K}, k AS sectors, floor(((atan2(y::DOUBLE, x::DOUBLE) + 2 * pi()) % (2 * pi())) / (2 * pi() / k))::INT % k AS sector, count(*) AS n
        FROM kept, (SELECT unnest([1, 2, 4, 8]) AS k) GROUP BY ALL""",
        "kept",
    )
)
def p17_sectors(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d)
    out = None
    for k in (1, 2, 4, 8):
        one = kept.groupBy(*FRAME, F.lit(k).alias("sectors"), g.sector(F.col("x"), F.col("y"), k).alias("sector")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    sql(
        f"SELECT {K}, row, col, round(p::DOUBLE, 6) AS p, p > 0.5 AS occupied, round(ln(q / (1 - q)), 4) + 0.0 AS back FROM (SELECT *, least(greatest(p::DOUBLE, 1e-6), 1 - 1e-6) AS q FROM map_coarse)",
        "map_coarse",
    )
)
def p18_probability(spark: SparkSession, d: str) -> DataFrame:
    m = _map(spark, d, coarse=True, merged=True)
    return m.select(*FRAME, *CELL, r6("p"), g.occupied(F.col("p")).alias("occupied"), (F.round(g.log_odds_of(F.col("p").cast("double")), 4) + 0.0).alias("back"))


@query(sql(f"SELECT {K}, row * 2 + i AS row, col * 2 + j AS col, round(p::DOUBLE, 6) AS p FROM map, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE p > 0.5", "map"))
def p19_upsample(spark: SparkSession, d: str) -> DataFrame:
    m = _map(spark, d, merged=True)
    return tier1.upsample(m.filter(g.occupied(F.col("p"))), 2).select(*FRAME, *CELL, r6("p"))


# --- joins


@query(sql(f'SELECT {K}, off AS "offset", j FROM pairs', "pairs"))
def j1_window_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tier1.window_pairs(fx.frames(spark, d), 2).select(*FRAME, "offset", "j")


@query(
    """WITH RECURSIVE hit AS (
      SELECT DISTINCT (l_partkey * 13 + l_orderkey) % 80 AS hr, (l_partkey * 7 + l_linenumber) % 80 AS hc FROM lineitem
    ), walk(hr, hc, r, c, err, i) AS (
      SELECT hr, hc, 40::BIGINT, 40::BIGINT, abs(hc - 40) - abs(hr - 40), 0 FROM hit
      UNION ALL
      SELECT hr, hc, r + CASE WHEN 2 * err < abs(hc - 40) THEN sign(hr - 40)::BIGINT ELSE 0 END, c + CASE WHEN 2 * err > -abs(hr - 40) THEN sign(hc - 40)::BIGINT ELSE 0 END,
        err - CASE WHEN 2 * err > -abs(hr - 40) THEN abs(hr - 40) ELSE 0 END + CASE WHEN 2 * err < abs(hc - 40) THEN abs(hc - 40) ELSE 0 END, i + 1
      FROM walk WHERE r <> hr OR c <> hc
    ) SELECT hr::INT AS hit_row, hc::INT AS hit_col, i::INT AS i, r::INT AS row, c::INT AS col FROM walk"""
)
def j2_rays(spark: SparkSession, d: str) -> DataFrame:
    hits = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("cast((l_partkey * 13 + l_orderkey) % 80 as int) AS hit_row", "cast((l_partkey * 7 + l_linenumber) % 80 as int) AS hit_col").distinct()
    cells = F.explode(ray(F.col("hit_row"), F.col("hit_col"), F.lit(40), F.lit(40)))
    return hits.select("hit_row", "hit_col", cells.alias("c")).select("hit_row", "hit_col", "c.i", "c.row", "c.col")


@query(sql(f"SELECT {K}, box_id, row, col FROM bcells", "bcells"))
def j3_box_cells(spark: SparkSession, d: str) -> DataFrame:
    return bx.rasterize(_boxes(spark, d))


@query(sql(f"SELECT {K}, box_id, n_box, n_hit FROM per_box", "per_box"))
def j4_box_hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.box_counts(_map(spark, d), _boxes(spark, d))


@query(sql(f"SELECT {K}, bin, d_est FROM firsthit", "firsthit"))
def j5_first_hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_hits(_map(spark, d))


@query(
    sql(
        f"SELECT {K}, row, col, round(coalesce(a.p::DOUBLE, 0.5) - coalesce(b.p::DOUBLE, 0.5), 6) + 0.0 AS diff FROM map a FULL JOIN (SELECT {K}, row, col, p FROM map_coarse) b USING ({K}, row, col)",
        "map",
        "map_coarse",
    )
)
def j6_map_difference(spark: SparkSession, d: str) -> DataFrame:
    return reports.difference(_map(spark, d), _map(spark, d, coarse=True)).select(*FRAME, *CELL, r6("diff"))


@query(sql(f"SELECT {K}, beta, gamma FROM frq, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS beta), (SELECT unnest([15.0::DOUBLE, 30.0]) AS gamma)", "frq"))
def j7_sweep(spark: SparkSession, d: str) -> DataFrame:
    return reports.sweep(fx.frames(spark, d).select(*FRAME), beta=[0.0, 0.5, 1.0], gamma=[15.0, 30.0])


# --- single scans, scenes and windows


@query(sql(f"SELECT {K}, row, col, n_hits, is_free FROM ev_coarse", "ev_coarse"))
def a1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return tier1.evidence(_kept(spark, d, coarse=True), merged=True)


@query(sql(f"SELECT {K}, row, col, round(value, 6) + 0.0 AS value, round(p::DOUBLE, 6) AS p FROM map_coarse", "map_coarse"))
def a2_single_scan(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, coarse=True, merged=True).select(*FRAME, *CELL, r6("value"), r6("p"))


@query(sql(f"SELECT {K}, row, col, round(value, 6) + 0.0 AS value, round(p::DOUBLE, 6) AS p FROM map_dense", "map_dense"))
def a2_dense_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scans of thousands of points each."""
    kept = preprocess.preprocess(fx.points(spark, d, dense=True), fx.frames(spark, d))
    return tier1.single_scan_map(kept).select(*FRAME, *CELL, r6("value"), r6("p"))


@query(sql(f"SELECT dataset, scene_id, row, col, n_scans, round(value, 6) + 0.0 AS value FROM ({fold('ev_coarse')})", "ev_coarse"))
def a3_scene_map(spark: SparkSession, d: str) -> DataFrame:
    return tier1.scene_map(_kept(spark, d, coarse=True)).select("dataset", "scene_id", *CELL, "n_scans", r6("value"))


@query(sql(f"SELECT dataset, scene_id, row, col, n_scans, round(value, 6) + 0.0 AS value FROM ({fold('world_ev')})", "world_ev"))
def a4_world_map(spark: SparkSession, d: str) -> DataFrame:
    return tier1.world_map(_kept(spark, d), fx.frames(spark, d)).select("dataset", "scene_id", *CELL, "n_scans", r6("value"))


@query(sql("SELECT dataset, scene_id, round(ox, 6) AS ox, round(oy, 6) AS oy FROM centre", "centre"))
def a5_centroid(spark: SparkSession, d: str) -> DataFrame:
    return tier1.centroid(fx.frames(spark, d)).select("dataset", "scene_id", r6("ox"), r6("oy"))


@query(sql(f"SELECT {K}, row, col, w, round(value, 6) + 0.0 AS value FROM fused", "fused"))
def a6_fusion(spark: SparkSession, d: str) -> DataFrame:
    window = tier1.window_points(fx.points(spark, d), fx.frames(spark, d), 2)
    return tier1.fuse_windows(window, [0, 1, 2], merged=True).select(*FRAME, *CELL, "w", fast6("value"))


@query(sql(f"SELECT {K}, count(*) FILTER (p > 0.5) AS n_occupied, round(count(*) FILTER (p > 0.5) * 100.0::DOUBLE / 6400, 6) AS occupied_pct FROM map GROUP BY ALL", "map"))
def a7_occupied_share(spark: SparkSession, d: str) -> DataFrame:
    return tier1.occupied_share(_map(spark, d)).select(*FRAME, "n_occupied", r6("occupied_pct"))


# --- scores


@query(sql(f"SELECT DISTINCT {K}, row, col FROM bcells", "bcells"))
def a8_truth_map(spark: SparkSession, d: str) -> DataFrame:
    return bx.truth_map(bx.rasterize(_boxes(spark, d)))


@query(sql(f"SELECT {K}, round(avg(n_hit::DOUBLE / n_box), 6) AS iobb, count(*) AS n_objects FROM per_box GROUP BY ALL", "per_box"))
def a9_iobb(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_share(metrics.box_counts(_map(spark, d), _boxes(spark, d))).select(*FRAME, r6("iobb"), "n_objects")


def _precision_sql(cells: str, boxes: str, zero: bool) -> str:
    score = "CASE WHEN nb > 0 AND n_occupied > 0 THEN round(n_true::DOUBLE / n_occupied, 6)" + (" WHEN nb > 0 THEN 0" if zero else "") + " END"
    return f"""SELECT {K}, n_occupied, n_true, {score} AS precision FROM (
      SELECT {K}, count(*) FILTER (p > 0.5) AS n_occupied, count(t.row) FILTER (p > 0.5) AS n_true FROM map LEFT JOIN (SELECT DISTINCT {K}, row, col FROM {cells}) t USING ({K}, row, col) GROUP BY ALL)
      LEFT JOIN (SELECT {K}, count(*) AS nb FROM {boxes} GROUP BY ALL) USING ({K})"""


@query(sql(_precision_sql("bcells", "box", False), "map", "bcells", "box"))
def a10_precision(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return metrics.box_precision(_map(spark, d), boxes, boxes).select(*FRAME, "n_occupied", "n_true", r6("precision"))


@query(
    sql(
        f"""SELECT {K}, round(iobb, 6) AS iobb, n_objects, n_occupied, precision FROM ({_precision_sql('kcells', 'labels', True)}) LEFT JOIN (
          SELECT {K}, avg(h::DOUBLE / n) AS iobb, count(*) AS n_objects FROM (SELECT {K}, box_id, count(*) AS n, count(o.row) AS h FROM kcells LEFT JOIN (SELECT * FROM occ) o USING ({K}, row, col) GROUP BY ALL) GROUP BY ALL) USING ({K})""",
        "map", "kcells", "labels", "occ",
    )
)
def a11_camera_scores(spark: SparkSession, d: str) -> DataFrame:
    labels, m = fx.labels(spark, d), _map(spark, d)
    boxes = bx.camera_boxes(labels)
    out = metrics.box_precision(m, boxes, labels, zero_outside=True).join(metrics.mean_share(metrics.box_counts(m, boxes)), FRAME, "left")
    return out.select(*FRAME, r6("iobb"), "n_objects", "n_occupied", r6("precision"))


@query(
    sql(
        f"SELECT {K}, n_inside, coalesce(n_overlap, 0)::BIGINT AS n_overlap FROM (SELECT {K}, count(*) FILTER (abs(cx) <= 20 AND abs(cy) <= 20) AS n_inside FROM box GROUP BY ALL) LEFT JOIN (SELECT {K}, sum(n_hit) AS n_overlap FROM per_box GROUP BY ALL) USING ({K})",
        "box", "per_box",
    )
)
def a12_overlay(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return metrics.overlaid(boxes, metrics.box_counts(_map(spark, d), boxes))


_NMSE = f"SELECT {K}, round(sum((d - coalesce(d_est, 28.4::DOUBLE)) ** 2) / sum(d * d), 6) AS nmse, count(*) AS n_bins FROM seen LEFT JOIN firsthit USING ({K}, bin) GROUP BY ALL"


@query(sql(_NMSE, "seen", "firsthit"))
def a13_angular_nmse(spark: SparkSession, d: str) -> DataFrame:
    kept = _kept(spark, d)
    return metrics.angular_nmse(tier1.single_scan_map(kept), kept).select(*FRAME, r6("nmse"), "n_bins")


@query(
    sql(
        f"""SELECT {K}, nmse, round(iobb, 6) AS iobb, n_objects, n_occupied, precision FROM ({_NMSE}) LEFT JOIN (SELECT {K}, avg(n_hit::DOUBLE / n_box) AS iobb, count(*) AS n_objects FROM per_box GROUP BY ALL) USING ({K})
        LEFT JOIN ({_precision_sql('bcells', 'box', False)}) USING ({K})""",
        "map", "bcells", "box", "per_box", "seen", "firsthit",
    )
)
def workload_a(spark: SparkSession, d: str) -> DataFrame:
    """Single-scan maps of every frame and all their scores."""
    kept, boxes = _kept(spark, d), _boxes(spark, d)
    out = metrics.scores(tier1.single_scan_map(kept), kept, boxes)
    return out.select(*FRAME, r6("nmse"), r6("iobb"), "n_objects", "n_occupied", r6("precision"))


# --- reports


@query(
    sql(
        """SELECT method, scene_id, frame_idx, grouping(frame_idx)::INT AS is_mean, round(avg(nmse), 8) AS nmse, round(avg(iobb), 8) AS iobb, round(avg(precision), 8) AS precision
        FROM res GROUP BY GROUPING SETS ((method, scene_id, frame_idx), (method))""",
        "res",
    )
)
def a14_report_means(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_means(fx.results(spark, d)).select("method", "scene_id", "frame_idx", "is_mean", *((F.round(c, 8) + 0.0).alias(c) for c in reports.METRICS))


@query(sql("SELECT method, count(*) AS n, round(count(*) FILTER (converged) / count(*)::DOUBLE, 6) AS converged_share, round(avg(iters), 6) AS mean_iters, (SELECT round(avg(iters) FILTER (beta = 0) / avg(iters) FILTER (beta = 1), 6) FROM res) AS ratio FROM res GROUP BY ALL", "res"))
def a15_convergence(spark: SparkSession, d: str) -> DataFrame:
    r = fx.results(spark, d)
    ratio = reports.iteration_ratio(r).first()["ratio"]
    return reports.convergence(r).select("method", "n", r6("converged_share"), r6("mean_iters"), r6(F.lit(ratio), "ratio"))


@query(
    sql(
        f"""SELECT count(*) FILTER (a < b) AS a_wins, count(*) FILTER (b < a) AS b_wins, count(*) FILTER (a = b) AS ties FROM (
          SELECT {K}, max(nmse) FILTER (method = 't2_beta0') AS a, max(nmse) FILTER (method = 't2_beta1') AS b FROM res GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL""",
        "res",
    )
)
def a16_wins(spark: SparkSession, d: str) -> DataFrame:
    return reports.wins(fx.results(spark, d), "t2_beta0", "t2_beta1")


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 9) AS delta, round(100 * (b - a) / a, 6) AS delta_pct FROM (SELECT avg({m}) FILTER (method = 't2_beta0') AS a, avg({m}) FILTER (method = 't2_beta1') AS b FROM res)"
            for m in ("nmse", "iobb", "precision")
        ),
        "res",
    )
)
def a17_relative_change(spark: SparkSession, d: str) -> DataFrame:
    return reports.relative_change(fx.results(spark, d), "t2_beta0", "t2_beta1").select("metric", r6("a"), r6("b"), (F.round("delta", 9) + 0.0).alias("delta"), r6("delta_pct"))


@query(
    sql(
        """SELECT scene_id, method, round(max(elapsed_s) FILTER (method = 't1') OVER w / elapsed_s, 6) AS speedup, round(nmse / max(nmse) FILTER (method = 't1') OVER w, 6) AS value_ratio
        FROM (SELECT scene_id, method, avg(elapsed_s) AS elapsed_s, avg(nmse) AS nmse FROM res GROUP BY ALL) WINDOW w AS (PARTITION BY scene_id)""",
        "res",
    )
)
def a18_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    means = fx.results(spark, d).groupBy("scene_id", "method").agg(F.avg("elapsed_s").alias("elapsed_s"), F.avg("nmse").alias("nmse"))
    return reports.against_baseline(means, "method", "t1").select("scene_id", "method", r6("speedup"), r6("value_ratio"))


@query(sql("SELECT beta, " + ", ".join(f"round(avg(nmse) FILTER (scene_id = '{s}'), 6) AS s{s}" for s in range(5)) + " FROM res GROUP BY ALL", "res"))
def a19_sweep_table(spark: SparkSession, d: str) -> DataFrame:
    out = reports.sweep_table(fx.results(spark, d), "beta", [str(s) for s in range(5)])
    return out.select("beta", *(r6(F.col(str(s)), f"s{s}") for s in range(5)))


@query(
    sql(
        """SELECT metric, method, round(avg(v) FILTER (dataset = 'a'), 6) AS a, round(avg(v) FILTER (dataset = 'b'), 6) AS b FROM (
          SELECT dataset, method, 'nmse' AS metric, nmse AS v FROM res UNION ALL SELECT dataset, method, 'iobb', iobb FROM res UNION ALL SELECT dataset, method, 'precision', precision FROM res) GROUP BY ALL""",
        "res",
    )
)
def a20_across_datasets(spark: SparkSession, d: str) -> DataFrame:
    return reports.across_datasets(fx.results(spark, d), ["a", "b"]).select("metric", "method", r6("a"), r6("b"))


@query(
    sql(
        f"""SELECT {K}, round(q, 6) AS p90, round(avg(p) FILTER (p > q), 6) AS mean_top, round(avg(p), 6) AS mean_p, count(*) FILTER (p > 0.5)::INT AS n_occupied FROM (
          SELECT *, quantile_cont(p, 0.9) OVER (PARTITION BY {K}) AS q FROM (
            SELECT {K}, row, col, coalesce(p::DOUBLE, 0.5) AS p FROM (SELECT * FROM (SELECT DISTINCT {K} FROM map_coarse), (SELECT unnest(range(80))::INT AS row), (SELECT unnest(range(80))::INT AS col)) LEFT JOIN map_coarse USING ({K}, row, col)))
        GROUP BY {K}, q""",
        "map_coarse",
    )
)
def a21_concentration(spark: SparkSession, d: str) -> DataFrame:
    return reports.concentration(_map(spark, d, coarse=True, merged=True)).select(*FRAME, r6("p90"), r6("mean_top"), r6("mean_p"), "n_occupied")


@query(
    sql(
        "SELECT method, count(nmse) AS n, round(min(nmse), 6) AS least, round(quantile_cont(nmse, 0.25), 6) AS q1, round(quantile_cont(nmse, 0.5), 6) AS median, round(quantile_cont(nmse, 0.75), 6) AS q3, round(max(nmse), 6) AS most FROM res GROUP BY ALL",
        "res",
    )
)
def a22_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.distribution(fx.results(spark, d)).select("method", "n", *(r6(c) for c in ("least", "q1", "median", "q3", "most")))


@query(sql("SELECT least(floor(p::DOUBLE * 50)::INT, 49) AS bin, count(*) AS n FROM map_coarse GROUP BY ALL", "map_coarse"))
def a22_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(_map(spark, d, coarse=True, merged=True))


@query(
    sql(
        f"SELECT {K}, row, round(sum(least(greatest(p, 0), 1) - 0.5), 5) + 0.0 AS s FROM smooth_cols GROUP BY ALL HAVING count(*) FILTER (abs(p - 0.5) > 1e-12) > 0",
        "smooth_cols",
    )
)
def a23_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return reports.smoothed(_map(spark, d)).groupBy(*FRAME, "row").agg((F.round(F.sum(F.col("p") - 0.5), 5) + 0.0).alias("s"))


# --- windows and the linear model


@query(
    sql(
        f"""SELECT {K}, bin, nth, round(x::DOUBLE, 6) + 0.0 AS x, round(y::DOUBLE, 6) + 0.0 AS y FROM (
          SELECT *, row_number() OVER (PARTITION BY {K}, bin ORDER BY rng, x, y) AS nth FROM (
            SELECT *, floor((atan2(y::DOUBLE, x::DOUBLE) + pi()) / (2 * pi() / 360))::INT % 360 AS bin, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE) AS rng FROM kept)) WHERE nth <= 3""",
        "kept",
    )
)
def w1_closest_hits(spark: SparkSession, d: str) -> DataFrame:
    return tier2.closest_hits(_kept(spark, d)).select(*FRAME, "bin", F.col("nth").cast("long").alias("nth"), r6("x"), r6("y"))


@query()
def w4_trace(spark: SparkSession, d: str) -> DataFrame:
    return reports.trace(tier2.swept_maps(_kept(spark, d), beta=[0.0, 1.0]))


@query(
    sql(
        f"""SELECT {K}, 'occupied' AS kind, hit_row, hit_col, row, col, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS y, n FROM model_rays WHERE i = m
        UNION ALL SELECT {K}, 'free', hit_row, hit_col, row, col, 0.5, 0.0, n FROM model_rays""",
        "model_rays",
    )
)
def t1_measurement_rows(spark: SparkSession, d: str) -> DataFrame:
    return tier2.measurement_rows(tier2.closest_hits(_kept(spark, d))).select(*FRAME, "kind", "hit_row", "hit_col", *CELL, "weight", "y", "n")


@query()
def t2_pcsbl(spark: SparkSession, d: str) -> DataFrame:
    return _solved_rows(tier2.frame_maps(_kept(spark, d)))


def _around(c: str) -> str:
    """Sum of the four neighbours of a cell, over a table of all cells."""
    sides = (f"{f}({c}) OVER (PARTITION BY {K}, {a} ORDER BY {b})" for a, b in (("row", "col"), ("col", "row")) for f in ("lag", "lead"))
    return " + ".join(f"coalesce({x}, 0)" for x in sides)


def _two_steps(beta: int) -> str:
    """Two steps of expectation-maximisation where rays have no weight, so that each cell is solved by itself."""
    coupled = lambda c: f"({c} + {beta} * ({_around(c)}))"
    update = lambda omega: f"least(greatest((2 * 1e-4::DOUBLE + 1) / (2 * 1e-4::DOUBLE + {omega}), 1e-3), 1e3)"
    cells = f"""SELECT {K}, row, col, coalesce(n, 0)::DOUBLE AS h FROM (SELECT * FROM (SELECT DISTINCT {K} FROM model_rays), (SELECT unnest(range(80))::INT AS row), (SELECT unnest(range(80))::INT AS col))
        LEFT JOIN (SELECT {K}, row, col, n FROM model_rays WHERE i = m) USING ({K}, row, col)"""
    start = f"SELECT *, {update('(30 * h / (30 * h + 1)) * (30 * h / (30 * h + 1)) + 1 / 30.0::DOUBLE')} AS a FROM ({cells})"

    def step(before: str) -> str:
        return f"SELECT *, 30 * h / d AS mu, (30 * h / d) * (30 * h / d) + 1 / d AS v FROM (SELECT {K}, row, col, h, a, {coupled('a')} + 30 * h AS d FROM ({before}))"

    first = f"SELECT {K}, row, col, h, {update(coupled('v'))} AS a FROM ({step(start)})"
    second = f"SELECT {K}, row, col, mu, 0.7::DOUBLE * a + 0.3::DOUBLE * {update(coupled('v'))} AS alpha FROM ({step(first)})"
    return sql(f"SELECT {K}, row, col, round(mu, 6) + 0.0 AS mu, round(alpha, 6) + 0.0 AS alpha FROM ({second}) SEMI JOIN model_rays USING ({K}, row, col)", "model_rays")


@query(_two_steps(1))
def t2_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """The first two steps of the solver, coupled to neighbours, without rays: the map itself, cell by cell."""
    solved = tier2.frame_maps(_kept(spark, d), Settings(beta=1.0, free_weight=0.0, max_iter=2))
    return tier2.solved_cells(solved).select(*FRAME, *CELL, r6("mu"), r6("alpha"))


@query(_two_steps(0))
def t6_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """As t2_two_steps, without the coupling, as one point of a sweep."""
    swept = tier2.swept_maps(_kept(spark, d), Settings(max_iter=2), beta=[0.0, 1.0], free_weight=[0.0])
    return tier2.solved_cells(swept.filter("beta = 0")).select(*FRAME, *CELL, r6("mu"), r6("alpha"))


#: Full solves that SQL can follow: 10 x 10 cells, 12 bearings, two hits in each.
COARSE = Grid(10, 4.0)
FEW = {"grid": COARSE, "hits": 2, "bins": 12}
DEFAULT = "1 AS beta, 30.0::DOUBLE AS gamma, 0.5::DOUBLE AS fw"


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.preprocess(fx.points(spark, d), fx.frames(spark, d), COARSE)


def _coarse_hits(key: str = K, source: str = "kept", settings: str = DEFAULT, more: str = "") -> str:
    """Hit cells of the coarse grid of keys with 5 points or more, with settings."""
    return f"""SELECT {key}, row, col, n, n AS h, n AS start, 5 AS er, 5 AS ec, {settings} FROM ({coarse_hits(source, key, 2, 12)})
      JOIN (SELECT {key} FROM {source} GROUP BY ALL HAVING count(*) >= 5) USING ({key}){more}"""


SWEPT = {"beta": [0.0, 1.0], "gamma": [15.0, 60.0], "free_weight": [0.0, 0.5]}
SWEPT_HITS = _coarse_hits(settings="beta, gamma, fw", more="".join(f", (SELECT unnest({v}::DOUBLE[]) AS {n})" for n, v in (("beta", SWEPT["beta"]), ("gamma", SWEPT["gamma"]), ("fw", SWEPT["free_weight"]))))


def _solved_rows(out: DataFrame, *key: str) -> DataFrame:
    out = out.select(*FRAME, *key, "iters", "converged", F.explode("cells").alias("c"))
    return out.select(*FRAME, *key, "iters", "converged", "c.row", "c.col", fast6("c.mu", "mu"), fast6("c.alpha", "alpha"))


def _set(out: DataFrame, **settings: float) -> DataFrame:
    return out.withColumns({n: F.lit(v) for n, v in settings.items()})


@query(solved(_coarse_hits(), 10, K, "kept"))
def t2_full_solve(spark: SparkSession, d: str) -> DataFrame:
    """Solves to the stop rule, with neighbours and rays: the map itself, cell by cell."""
    return _solved_rows(_set(tier2.frame_maps(_coarse(spark, d), **FEW), beta=1, gamma=30.0, free_weight=0.5), *SWEPT)


@query(solved(SWEPT_HITS, 10, K, "kept"))
def t6_full_sweep(spark: SparkSession, d: str) -> DataFrame:
    """As t2_full_solve, for eight settings a frame."""
    return _solved_rows(tier2.swept_maps(_coarse(spark, d), **FEW, **SWEPT), *SWEPT)


@query(
    solved(
        _coarse_hits(settings="beta, 30.0::DOUBLE AS gamma, 0.5::DOUBLE AS fw", more=", (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS beta)"),
        10,
        K,
        "kept",
        final=f"""SELECT {K}, beta, iteration, round(rel_change, 6) + 0.0 AS rel_change, round(rel_change - lag(rel_change) OVER (PARTITION BY {K}, beta ORDER BY iteration), 6) + 0.0 AS step
          FROM (SELECT *, unnest(history) AS rel_change, unnest(range(1, len(history) + 1))::INT AS iteration FROM em WHERE done OR it = 150)""",
    )
)
def w4_full_trace(spark: SparkSession, d: str) -> DataFrame:
    out = reports.trace(tier2.swept_maps(_coarse(spark, d), **FEW, beta=[0.0, 1.0]))
    return out.select(*FRAME, "beta", "iteration", r6("rel_change"), r6("step"))


_SECTOR = f"SELECT *, floor(((atan2(y::DOUBLE, x::DOUBLE) + 2 * pi()) % (2 * pi())) / (2 * pi() / 2))::INT AS sector FROM kept"


@query(solved(_coarse_hits(f"{K}, sector", f"({_SECTOR})"), 10, f"{K}, sector", "kept", final=f"SELECT {K}, row, col, round(max(least(greatest(mu, 0), 1)::FLOAT)::DOUBLE, 6) + 0.0 AS p FROM cells GROUP BY ALL"))
def t3_full_sectors(spark: SparkSession, d: str) -> DataFrame:
    return tier2.sector_maps(_coarse(spark, d), 2, **FEW).select(*FRAME, *CELL, r6("p"))


def _window_hits(gamma: float) -> str:
    """Hits of windows of two frames on either side, picked by frame seen, weighted by its distance."""
    return f"""SELECT {K}, row, col, sum(n)::DOUBLE AS n, sum(n * 0.85::DOUBLE ** (2 * abs(off)))::DOUBLE AS h, sum(n * 0.85::DOUBLE ** (2 * abs(off)))::DOUBLE AS start, 5 AS er, 5 AS ec,
      1 AS beta, {gamma}::DOUBLE AS gamma, 0.5::DOUBLE AS fw FROM ({coarse_hits("window_kept", K, 2, 12, ", off")}) GROUP BY ALL"""


def _window(spark: SparkSession, d: str, gamma: float) -> DataFrame:
    window = tier1.window_points(fx.points(spark, d), fx.frames(spark, d), 2, COARSE)
    return _solved_rows(_set(tier2.window_maps(window, settings=Settings(gamma=gamma), **FEW), beta=1, gamma=gamma, free_weight=0.5), *SWEPT)


@query(solved(_window_hits(30.0), 10, K, "window_kept"))
def t4_full_windows(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d, 30.0)


@query(solved(_window_hits(0.0), 10, K, "window_kept"))
def t4_adaptive_noise(spark: SparkSession, d: str) -> DataFrame:
    """As t4_full_windows, with the noise estimated in each step; weights differ by frame seen."""
    return _window(spark, d, 0.0)


_TILES = f"""SELECT {K}, tile_row, tile_col, x, y, least(greatest(floor((20 - (tile_row + 0.5) * 20 - y) / 4.0 + 2.5)::INT, 0), 4) AS row, least(greatest(floor((x - ((tile_col + 0.5) * 20 - 20)) / 4.0 + 2.5)::INT, 0), 4) AS col
  FROM kept, (SELECT unnest([0, 1]) AS tile_row), (SELECT unnest([0, 1]) AS tile_col) WHERE abs(x) <= 10 AND abs(y) <= 10"""
_TILE_HITS = f"""SELECT {K}, tile_row, tile_col, row, col, count(*)::DOUBLE AS n, count(*)::DOUBLE AS h, count(*)::DOUBLE AS start, least(5 - 5 * tile_row, 4) AS er, least(5 - 5 * tile_col, 4) AS ec, {DEFAULT} FROM (
    SELECT *, row_number() OVER (PARTITION BY {K}, tile_row, tile_col, bin ORDER BY rng, x, y) AS nth, count(*) OVER (PARTITION BY {K}, tile_row, tile_col) AS points FROM (
      SELECT *, floor((atan2(y::DOUBLE, x::DOUBLE) + pi()) / (2 * pi() / 12))::INT % 12 AS bin, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE) AS rng FROM ({_TILES})))
  WHERE nth <= 2 AND points >= 5 GROUP BY ALL"""


@query(
    solved(
        _TILE_HITS,
        5,
        f"{K}, tile_row, tile_col",
        "kept",
        final=f"SELECT {K}, (row + 5 * tile_row)::INT AS row, (col + 5 * tile_col)::INT AS col, round(least(greatest(mu, 0), 1)::FLOAT::DOUBLE, 6) + 0.0 AS p FROM cells",
    )
)
def t5_full_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tier2.tile_maps(_coarse(spark, d), 2, **FEW).select(*FRAME, *CELL, r6("p"))


@query()
def t3_sectors(spark: SparkSession, d: str) -> DataFrame:
    return tier2.sector_maps(_kept(spark, d), 2)


@query()
def t4_window_solve(spark: SparkSession, d: str) -> DataFrame:
    return _solved_rows(tier2.window_maps(tier1.window_points(fx.points(spark, d), fx.frames(spark, d), 2)))


@query()
def t5_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tier2.tile_maps(_kept(spark, d), 2)


@query()
def t6_sweep(spark: SparkSession, d: str) -> DataFrame:
    return tier2.swept_maps(_kept(spark, d), beta=[0.0, 1.0]).select(*FRAME, "beta", "iters", "converged", "error")


# --- catalogue


@query("SELECT 'scene-' || s_nationkey AS name, '' AS description, count(*)::INT AS nbr_samples FROM supplier GROUP BY s_nationkey")
def c1_list_scenes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_scenes(fx.scenes(spark, d))


@query("SELECT 's' || s_nationkey AS scene_token, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS frame_idx, 'm' || s_suppkey AS sample_token, 'samples/LIDAR_TOP/' || s_suppkey || '.bin' AS filename FROM supplier")
def c3_keyframes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keyframes(fx.samples(spark, d), fx.sample_data(spark, d)).select("scene_token", "frame_idx", "sample_token", "filename")


@query("SELECT 's' || s_nationkey AS scene_token, 'm' || s_suppkey AS sample_token, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS place FROM supplier")
def c3_linked_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.linked_order(fx.scenes(spark, d), fx.samples(spark, d))


@query(sql(f"SELECT {K} FROM (SELECT DISTINCT {K} FROM pts INTERSECT SELECT DISTINCT {K} FROM labels WHERE abs(x) < 100)", "pts", "labels"))
def c6_complete_frames(spark: SparkSession, d: str) -> DataFrame:
    return catalog.complete_frames(fx.points(spark, d), fx.labels(spark, d).filter(F.abs("x") < 100))


@query(sql(f"SELECT {K} FROM frq WHERE ({K}) NOT IN (SELECT {K} FROM kbox)", "frq", "kbox"))
def c8_frames_without_boxes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frames_without_boxes(fx.frames(spark, d).select(*FRAME), bx.camera_boxes(fx.labels(spark, d)))


@query(sql(f"SELECT {K} FROM frq ORDER BY scene_id, frame_idx LIMIT 25 OFFSET 7", "frq"))
def c10_frame_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frame_range(fx.frames(spark, d).select(*FRAME), 7, 25)


@query(sql(f"SELECT {K} FROM frq WHERE frame_idx = 1", "frq"))
def c11_nth_scan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.nth_scan(fx.frames(spark, d).select(*FRAME), 1)


@query("SELECT 'scene-' || s_nationkey AS name, '' AS description, count(*)::INT AS nbr_samples FROM supplier GROUP BY s_nationkey ORDER BY name LIMIT 1")
def c2_scene_by_name(spark: SparkSession, d: str) -> DataFrame:
    scenes = fx.scenes(spark, d)
    return catalog.list_scenes(catalog.scene_by_name(scenes, scenes.agg(F.min("name")).first()[0]))


def _poses(spark: SparkSession, d: str) -> DataFrame:
    return fx.frames(spark, d).selectExpr("concat('p', cast(scene_id AS int) + 5 * frame_idx) AS token", "pose_q AS rotation", "pose_t AS translation")


@query(
    sql(
        """SELECT 's' || s_nationkey AS scene_token, row_number() OVER (PARTITION BY s_nationkey ORDER BY s.s_suppkey) - 1 AS frame_idx, round(px, 6) + 0.0 AS px, round(r10, 6) + 0.0 AS r10, (s.s_suppkey % 4) * 0.5::DOUBLE AS cz
        FROM supplier s JOIN frm USING (s_suppkey)""",
        "frm",
    )
)
def c4_lookups(spark: SparkSession, d: str) -> DataFrame:
    keys = catalog.keyframes(fx.samples(spark, d), fx.sample_data(spark, d))
    sensors = spark.range(4).selectExpr("concat('c', id) AS token", "array(1D, 0D, 0D, 0D) AS rotation", "array(0D, 0D, id * 0.5D) AS translation")
    out = catalog.with_lookups(keys, _poses(spark, d), sensors)
    return out.select("scene_token", "frame_idx", r6(F.col("pose_t")[0], "px"), r6(F.col("pose_r")[3], "r10"), r6(F.col("calib_t")[2], "cz"))


@query("SELECT 's' || s_nationkey AS scene_token, 'm' || s_suppkey AS sample_token, count(*) AS n FROM supplier JOIN orders ON o_custkey % (SELECT count(*) FROM supplier) = s_suppkey GROUP BY ALL")
def c5_annotations(spark: SparkSession, d: str) -> DataFrame:
    keys = catalog.keyframes(fx.samples(spark, d), fx.sample_data(spark, d))
    boxes = fx.boxes(spark, d).selectExpr("box_id", "concat('m', cast(scene_id AS int) + 5 * frame_idx) AS sample_token")
    return catalog.annotations_of(keys, boxes).groupBy("scene_token", "sample_token").agg(F.count("*").alias("n"))


@query(sql("SELECT scene_id, count(*) AS n FROM frq WHERE scene_id IN ('1', '3') GROUP BY ALL", "frq"))
def c7_sequences_with_poses(spark: SparkSession, d: str) -> DataFrame:
    posed = fx.frames(spark, d).filter("scene_id in ('1', '3')").select("scene_id")
    return catalog.sequences_with_poses(fx.frames(spark, d), posed).groupBy("scene_id").agg(F.count("*").alias("n"))


@query(sql(f"SELECT {K}, CASE WHEN frame_idx % 2 = 0 THEN 1.84 ELSE 1.73 END::DOUBLE AS tz, CASE WHEN frame_idx % 3 = 0 THEN round(px, 6) ELSE 0 END + 0.0 AS px, 1.0::DOUBLE AS r00 FROM frq", "frq"))
def c9_defaults(spark: SparkSession, d: str) -> DataFrame:
    known = fx.frames(spark, d).withColumns({c: F.when(F.col("frame_idx") % 2 == 0, F.col(c)) for c in ("calib_r", "calib_t")})
    known = known.withColumns({c: F.when(F.col("frame_idx") % 3 == 0, F.col(c)) for c in ("pose_r", "pose_t")})
    out = preprocess.with_defaults(known)
    return out.select(*FRAME, r6(F.col("calib_t")[2], "tz"), r6(F.col("pose_t")[0], "px"), r6(F.col("calib_r")[0], "r00"))


@query(sql(f"SELECT {K}, 1.84::DOUBLE AS ring FROM frq UNION ALL SELECT 'other', scene_id, frame_idx, NULL FROM frq", "frq"))
def c12_one_interface(spark: SparkSession, d: str) -> DataFrame:
    own = fx.frames(spark, d).select(*FRAME, F.col("calib_t")[2].alias("ring"))
    return catalog.one_interface(own, own.drop("ring").withColumn("dataset", F.lit("other")))


@query("SELECT 'driver' AS dataset, s_nationkey::VARCHAR AS scene_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS frame_idx FROM supplier")
def w3_frame_order(spark: SparkSession, d: str) -> DataFrame:
    files = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("'driver' AS dataset", "cast(s_nationkey AS string) AS scene_id", "s_suppkey")
    return catalog.numbered(files, "s_suppkey")


@query("SELECT l_returnflag AS split, count(*) AS n_files FROM lineitem GROUP BY l_returnflag")
def c1_files_by_split(spark: SparkSession, d: str) -> DataFrame:
    return catalog.files_by_split(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("split")))


# --- files


@query(
    """SELECT kind, n, round(total, 6) AS total FROM (SELECT 'scene' AS kind, count(DISTINCT s_nationkey) AS n, sum(per)::DOUBLE AS total FROM (SELECT s_nationkey, count(*) AS per FROM supplier GROUP BY s_nationkey)
    UNION ALL SELECT 'sample', count(*), sum(1000.0::DOUBLE * s_suppkey) FROM supplier
    UNION ALL SELECT 'sample_data', 3 * count(*), 2.0::DOUBLE * count(*) FROM supplier
    UNION ALL SELECT 'ego_pose', count(*), sum(1000.0::DOUBLE * (s_suppkey % 5) + 8 * (s_suppkey // 5) / 10.0) FROM supplier
    UNION ALL SELECT 'calibrated_sensor', count(*), sum(c * 0.5::DOUBLE) FROM (SELECT DISTINCT s_suppkey % 4 AS c FROM supplier)
    UNION ALL SELECT 'sample_annotation', count(*), sum(1.5::DOUBLE + (o_orderkey % 5) / 4.0) FROM orders)"""
)
def s1_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Tables of metadata written as JSON arrays and read again: rows, and the sum of a column, of each."""
    root = new_folder(spark)
    fx.metadata(spark, d, root)
    sums = {"scene": "nbr_samples", "sample": "timestamp", "sample_data": "cast(is_key_frame AS int)", "ego_pose": "translation[0]", "calibrated_sensor": "translation[2]", "sample_annotation": "size[0]"}
    found = readers.read_metadata(spark, root)
    parts = [found[name].select(F.lit(name).alias("kind"), F.expr(c).cast("double").alias("v")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total")) for name, c in sums.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""SELECT 'scan/' || l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY kx, ky, kz, ki, kr) - 1 AS point_idx, kx / 4.0::DOUBLE AS x, ky / 4.0::DOUBLE AS y, kz / 4.0::DOUBLE AS z, ki / 4.0::DOUBLE AS intensity, kr / 4.0::DOUBLE AS ring
    FROM (SELECT l_suppkey, {', '.join(fx.QUARTERS)} FROM lineitem)"""
)
def s2_scans(spark: SparkSession, d: str) -> DataFrame:
    return readers.decode_points(fx.scans(spark, d), 5).select("path", "point_idx", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity", "ring")))


_PATH = "'file/' || o_orderkey AS path"


def _ends(first: str, n: int) -> str:
    return f"{n} AS n, ({first}) + 0.25::DOUBLE AS first, ({first}) + {n - 1} + 0.25::DOUBLE AS last"


@query(
    f"""SELECT {_PATH}, 'P0' AS name, {_ends('if(o_orderkey % 5 = 0, o_orderkey % 71, o_orderkey % 97)', 12)} FROM orders
    UNION ALL SELECT {_PATH}, 'R0_rect', {_ends('o_orderkey % 89', 9)} FROM orders
    UNION ALL SELECT {_PATH}, ['Tr', 'Tr_velo_to_cam', 'Tr_velo_cam'][o_orderkey % 3 + 1], {_ends('o_orderkey % 83', 12)} FROM orders"""
)
def s3_calibration(spark: SparkSession, d: str) -> DataFrame:
    named = readers.calib_of(fx.calib_lines(spark, d)).select("path", F.explode("m").alias("name", "v"))
    return named.select("path", "name", F.size("v").alias("n"), F.col("v")[0].alias("first"), F.element_at("v", -1).alias("last"))


@query(f"SELECT {_PATH}, {_ends('o_orderkey % 83', 12)} FROM orders")
def s4_sensor_matrix(spark: SparkSession, d: str) -> DataFrame:
    found = readers.with_sensor_matrix(readers.calib_of(fx.calib_lines(spark, d)))
    return found.select("path", F.size("tr").alias("n"), F.col("tr")[0].alias("first"), F.element_at("tr", -1).alias("last"))


_LABELS = f"""SELECT {_PATH}, 0 AS box_id, ['Car', 'Van', 'Truck', 'Pedestrian', 'Cyclist', 'Tram', 'DontCare', 'Misc'][o_orderkey % 8 + 1] AS class, CASE WHEN o_orderkey % 13 > 0 THEN 1 + o_orderkey % 3 + 0.5::DOUBLE END AS h,
      (3 + o_orderkey % 2)::DOUBLE AS l, CASE WHEN o_orderkey % 40 = 20 THEN 0.25 WHEN o_orderkey % 40 < 20 THEN o_orderkey % 40 - 20 - 0.25 ELSE o_orderkey % 40 - 20 + 0.25 END::DOUBLE AS x, (o_orderkey % 50)::DOUBLE AS z,
      CASE WHEN o_orderkey % 11 > 0 THEN [-2.5, -1.5, 0.5, 1.5][o_orderkey % 4 + 1]::DOUBLE END AS rotation_y FROM orders
    UNION ALL SELECT {_PATH}, 2, 'Car', 1.5, 4.0, o_orderkey % 7 + 0.5::DOUBLE, 20.0, 0.0 FROM orders"""


@query(f"SELECT * FROM ({_LABELS}) WHERE class NOT IN ('DontCare', 'Misc') AND rotation_y IS NOT NULL")
def s5_strict_labels(spark: SparkSession, d: str) -> DataFrame:
    return readers.labels_of(fx.label_lines(spark, d)).select("path", "box_id", "class", "h", "l", "x", "z", "rotation_y")


@query(f"SELECT * FROM ({_LABELS}) WHERE class <> 'DontCare' AND h IS NOT NULL AND rotation_y IS NOT NULL")
def s6_lenient_labels(spark: SparkSession, d: str) -> DataFrame:
    return readers.labels_of(fx.label_lines(spark, d), strict=False).select("path", "box_id", "class", "h", "l", "x", "z", "rotation_y")


@query(" UNION ALL ".join(f"SELECT {_PATH}, {i} AS frame_idx, {_ends(f'o_orderkey % {m}', 12)} FROM orders" for i, m in enumerate((97, 89, 83))))
def s7_poses(spark: SparkSession, d: str) -> DataFrame:
    found = readers.poses_of(fx.pose_lines(spark, d))
    return found.select("path", "frame_idx", F.size("p").alias("n"), F.col("p")[0].alias("first"), F.element_at("p", -1).alias("last"))


_LOGGED = ("dataset", "scene_id", "frame_idx", "mode", "beta", "nmse", "iobb", "precision", "iters", "converged", "elapsed_s")


@query(sql("SELECT dataset, scene_id, frame_idx, method AS mode, beta::DOUBLE AS beta, nmse, iobb, precision, iters, converged, elapsed_s, true AS no_error FROM res", "res"))
def s8_results_log(spark: SparkSession, d: str) -> DataFrame:
    """Results added to a log in two runs, and read again."""
    path, rows = new_folder(spark), fx.results(spark, d).withColumnRenamed("method", "mode")
    for beta in (0, 1):
        readers.append_results(rows.filter(F.col("beta") == beta), path)
    return readers.read_results(spark, path).select(*_LOGGED, F.col("error").isNull().alias("no_error"))


@query(sql("SELECT dataset, method, count(nmse) AS n, round(min(nmse), 6) AS least FROM res WHERE beta = 1 GROUP BY ALL", "res"))
def s9_report_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """A report written twice: the second run's rows alone are left."""
    path, rows = new_folder(spark), fx.results(spark, d)
    for part in (rows, rows.filter("beta = 1")):
        readers.write_report(part.groupBy("dataset", "method").agg(F.count("nmse").alias("n"), r6(F.min("nmse"), "least")), path)
    return spark.read.parquet(path)


@query(sql("SELECT method AS kind, dataset, scene_id, frame_idx, nmse FROM (SELECT *, max(frame_idx) OVER (PARTITION BY method) AS newest FROM res) WHERE frame_idx = newest", "res"))
def s10_latest_report(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d).withColumnRenamed("method", "kind").withColumn("run_ts", F.timestamp_seconds(F.col("frame_idx") * 3600))
    return readers.latest(rows).select("kind", "dataset", "scene_id", "frame_idx", "nmse")


@query(sql(f"SELECT {K}, count(*) AS n FROM kbox WHERE frame_idx % 2 = 0 AND ({K}) IN (SELECT {K} FROM frq) GROUP BY ALL", "kbox", "frq"))
def c8_usable_boxes(spark: SparkSession, d: str) -> DataFrame:
    calibrated = fx.frames(spark, d).filter("frame_idx % 2 = 0")
    return catalog.usable_boxes(bx.camera_boxes(fx.labels(spark, d)), calibrated).groupBy(*FRAME).agg(F.count("*").alias("n"))
