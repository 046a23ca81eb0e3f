"""Log-odds maps by an inverse sensor model: single scans, scenes, and windows of frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.rays import along_rays, fused_rays, merged_rays
from ..grid import CELL, EVIDENCE, FRAME, LIMIT, Grid
from .preprocess import discretize, height_filter, project, range_filter, transform_to_ego

#: Frames of a scene that are folded as one list.
FOLD = 512
#: Frames of a scene whose windows are made in one task.
SPAN = 32
#: Columns that deal out scans to tasks. Grouping by any key that holds them needs no further shuffle, also where ``dataset`` is one
#: constant, which Spark would tell apart from itself.
DEALT = ["scene_id", "frame_idx"]


def dealt(rows: DataFrame, by: Sequence[str] = DEALT) -> DataFrame:
    """Rows dealt out by scan, in as many parts as the session shuffles into: a scan's rows are few bytes that grow to whole maps, so
    parts must not be joined by their size."""
    return rows.repartition(parts(rows.sparkSession), *by)


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def evidence(cells: DataFrame, key: Sequence[str] = FRAME, grid: Grid = Grid(), ego: tuple[Column, Column] | None = None, merged: bool = False) -> DataFrame:
    """``key, row, col, n_hits, is_free``: points that end in a cell, and whether a ray of the scan passes it before its end.

    ``cells`` has a row for each point. Points are counted first, so each hit cell sends one ray however many points it
    has; counted cells are dealt out by ``key`` (a scan is small), and rays are then made and merged without another
    shuffle. ``ego``: columns with the ego cell, if it isn't the middle. A ``span`` in the key says that cells are dealt
    out by it already (see window_points). ``merged``: rays are drawn into their scan's map in Arrow
    batches (see merged_rays), not merged as rows of a task's table of all cells, which is several times the work. Spark then doesn't
    know that cells lie by scan, so this suits maps that are written, or first counted inside their tasks.
    """
    row, col = ego or (F.lit(grid.ego[0]), F.lit(grid.ego[1]))
    hits = cells.groupBy(*key, *CELL, row.alias("_er"), col.alias("_ec")).agg(F.count("*").alias("n"))
    hits = hits if "span" in key else dealt(hits)
    if merged:
        return merged_rays(hits, key, *CELL, "_er", "_ec", "n")
    line = along_rays(hits, *CELL, "_er", "_ec")
    end = F.col("i") == F.col("m")
    return (
        line.select(*key, F.col("at_row").alias("row"), F.col("at_col").alias("col"), F.when(end, F.col("n")).otherwise(0).alias("n"), (~end).cast("int").alias("free"))
        .groupBy(*key, *CELL)
        .agg(F.sum("n").alias("n_hits"), F.max("free").alias("is_free"))
    )


def scan_map(found: DataFrame) -> DataFrame:
    """``value`` (log-odds) and ``p`` of each touched cell of a scan; other cells are unknown (0, one half)."""
    value = g.scan_log_odds(F.col("n_hits"), F.col("is_free"))
    return found.withColumn("value", value).withColumn("p", g.probability(F.col("value"))).drop("n_hits", "is_free")


def single_scan_map(cells: DataFrame, grid: Grid = Grid(), merged: bool = False) -> DataFrame:
    return scan_map(evidence(cells, grid=grid, merged=merged))


def occupied_share(maps: DataFrame, key: Sequence[str] = FRAME, grid: Grid = Grid(), threshold: float = 0.5) -> DataFrame:
    """``n_occupied`` and ``occupied_pct`` (of all cells) of each map."""
    n = F.count_if(g.occupied(F.col("p"), threshold))
    return maps.groupBy(*key).agg(n.alias("n_occupied"), (n * 100.0 / (grid.size * grid.size)).alias("occupied_pct"))


def folded(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scans of one ``key`` and cell, in the order of frame_idx, added up with a clamp after each; so order matters.

    Scans are folded in ranges of FOLD frames, and then the ranges: a clamped step adds ``add`` and keeps the sum from
    ``low`` to ``high``, and one such step after another is again one. So no list is longer than FOLD, or than the number of ranges.
    """
    step = F.struct(
        F.col("frame_idx").alias("at"),
        (F.col("n_hits") * EVIDENCE - F.col("is_free") * EVIDENCE).alias("add"),
        F.lit(-LIMIT).alias("low"),
        F.greatest(F.lit(-LIMIT), F.lit(LIMIT) - F.col("is_free") * EVIDENCE).alias("high"),
        F.lit(1).cast("long").alias("n"),
    )

    def after(a: Column, b: Column) -> Column:
        within = lambda v: F.greatest(b["low"], F.least(b["high"], v + b["add"]))
        return F.struct(a["at"].alias("at"), (a["add"] + b["add"]).alias("add"), within(a["low"]).alias("low"), within(a["high"]).alias("high"), (a["n"] + b["n"]).alias("n"))

    def composed(df: DataFrame, by: list[Column]) -> DataFrame:
        return df.groupBy(*by).agg(F.array_sort(F.collect_list("step")).alias("steps")).withColumn("step", F.reduce(F.slice("steps", 2, F.size("steps")), F.element_at("steps", 1), after)).drop("steps")

    ranges = composed(found.select(*key, *CELL, F.floor(F.col("frame_idx") / FOLD).alias("_range"), step.alias("step")), [*key, *CELL, "_range"])
    out = composed(ranges.drop("_range"), [*key, *CELL]).select(*key, *CELL, F.greatest("step.low", F.least("step.high", "step.add")).alias("value"), F.col("step.n").alias("n_scans"))
    return out.withColumn("p", g.probability(F.col("value")))


def scene_map(cells: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """All scans of a scene stacked in ego axes."""
    return folded(evidence(cells, grid=grid), ["dataset", "scene_id"])


def centroid(frames: DataFrame) -> DataFrame:
    """``ox, oy``: mean position of each scene's trajectory."""
    return frames.groupBy("dataset", "scene_id").agg(F.avg(F.col("pose_t")[0]).alias("ox"), F.avg(F.col("pose_t")[1]).alias("oy"))


def world_cells(points: DataFrame, frames: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Points (ego axes, from above) moved by the vehicle's offset from the scene's centroid, not turned, with the cell of
    each point and of the vehicle, clipped to the map."""
    moved = frames.join(centroid(frames), ["dataset", "scene_id"])
    shift = moved.select(*FRAME, (F.col("pose_t")[0] - F.col("ox")).alias("dx"), (F.col("pose_t")[1] - F.col("oy")).alias("dy"))
    out = points.join(shift, FRAME).withColumns({"x": F.col("x").cast("double") + F.col("dx"), "y": F.col("y").cast("double") + F.col("dy")})
    out = out.filter((F.abs("x") <= grid.half) & (F.abs("y") <= grid.half))
    clip = lambda c: F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(grid.size - 1))
    out = discretize(out, grid)
    return out.withColumns({"ego_row": clip((grid.half - F.col("dy")) / grid.cell), "ego_col": clip((F.col("dx") + grid.half) / grid.cell)})


def world_map(points: DataFrame, frames: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """All scans of a scene in one map around its trajectory's mean."""
    cells = world_cells(points, frames, grid)
    return folded(evidence(cells, grid=grid, ego=(F.col("ego_row"), F.col("ego_col"))), ["dataset", "scene_id"])


def window_pairs(frames: DataFrame, w: int) -> DataFrame:
    """``dataset, scene_id, frame_idx, offset, j``: for each frame the frames at most ``w`` away in its scene.

    The neighbours' numbers are listed and looked up by equality; windows end at the ends of a scene.
    """
    wanted = frames.select(*FRAME, F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("offset")).withColumn("j", F.col("frame_idx") + F.col("offset"))
    known = frames.select("dataset", "scene_id", F.col("frame_idx").alias("j"))
    return wanted.join(known, ["dataset", "scene_id", "j"])


def spanned(rows: DataFrame, w: int, frame: str = "frame_idx") -> DataFrame:
    """Rows with ``span``: that of their frame, and again those of neighbours that have a frame at most ``w`` away."""
    span_of = lambda f: F.floor(f / SPAN).cast("int")
    return rows.withColumn("span", F.explode(F.sequence(span_of(F.col(frame) - w), span_of(F.col(frame) + w))))


def window_points(points: DataFrame, frames: DataFrame, w: int, grid: Grid = Grid()) -> DataFrame:
    """Points of each window in the axes of its frame, with ``offset``, ``span`` and cells. Heights are filtered first, in the axes of
    the frame that saw them and before points fan out to their windows; ranges are filtered in the window's axes.

    Frames of a scene are dealt out in spans of SPAN. A scan is one row, with its pose and those of its windows. It goes to its own
    span, and to a neighbouring one only if that has a frame at most ``w`` away; so 1 + 2 w / SPAN of the scans are shuffled, and
    their points fan out to their windows inside the span's task.
    """
    scene = ["dataset", "scene_id"]
    seen = height_filter(transform_to_ego(points, frames)).withColumnRenamed("frame_idx", "j")
    rest = [c for c in seen.columns if c not in (*scene, "j")]
    scans = dealt(seen, ["scene_id", "j"]).groupBy(*scene, "j").agg(F.collect_list(F.struct(*rest)).alias("seen"))
    # poses as plain numbers, and each step unpacked from a struct: so that a point is moved once, not again in each part of the filter
    pose = [F.col(f"pose_{m}")[i].alias(f"{m}{i}") for m, n in (("r", 9), ("t", 3)) for i in range(n)]
    of = lambda c: ([F.col(f"{c}.r{i}") for i in range(9)], [F.col(f"{c}.t{i}") for i in range(3)])
    own = frames.select(*scene, F.col("frame_idx").alias("j"), F.struct(*pose).alias("_j"))
    near = frames.select(*scene, F.floor(F.col("frame_idx") / SPAN).cast("int").alias("span"), F.struct(F.col("frame_idx").alias("k"), *pose).alias("_k"), F.explode(F.sequence(F.col("frame_idx") - w, F.col("frame_idx") + w)).alias("j"))
    near = near.groupBy(*scene, "j", "span").agg(F.collect_list("_k").alias("windows"))
    spans = dealt(scans.join(own, [*scene, "j"]).join(near, [*scene, "j"]), ["scene_id", "span"])
    out = spans.select(*scene, "span", "j", "windows", "_j", F.explode("seen").alias("s"))
    world = [c.alias(f"w{n}") for n, c in zip("xyz", g.apply(*of("_j"), [F.col(f"s.{c}").cast("double") for c in "xyz"]), strict=True)]
    out = out.select(*scene, "span", "j", "windows", *(f"s.{c}" for c in rest if c not in "xyz"), F.inline(F.array(F.struct(*world))))
    out = out.select("*", F.explode("windows").alias("_k")).drop("windows")
    moved = F.struct(*(c.alias(n) for n, c in zip("xyz", g.from_world([F.col(f"w{c}") for c in "xyz"], *of("_k")), strict=True)))
    out = out.select("*", F.col("_k.k").alias("frame_idx"), (F.col("j") - F.col("_k.k")).alias("offset"), F.inline(F.array(moved))).drop("wx", "wy", "wz", "_k", "j")
    return discretize(project(range_filter(out, grid)), grid)


def fuse_windows(window: DataFrame, windows: Sequence[int], decay: float = 0.85, grid: Grid = Grid(), merged: bool = False) -> DataFrame:
    """``frame key, row, col, w, value, p``: single-scan maps of a window's frames, weighted by decay^|offset|, added and clamped,
    for each half width in ``windows``, all from one pass over the widest (``window``: from window_points, whose spans hold every frame
    of a window, so that nothing is shuffled again). ``merged``: rays are drawn into their scans' maps, and these added, in Arrow batches (see
    fused_rays), not as rows of a task's table of all cells."""
    frame = [*FRAME, "span"]
    clamped = lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col(v))).alias("value")
    if merged:
        hits = window.groupBy(*frame, "offset", *CELL).agg(F.count("*").alias("n"))
        out = fused_rays(hits, frame, windows, decay, grid.ego).select(*FRAME, *CELL, "w", clamped("value"))
        return out.withColumn("p", g.probability(F.col("value")))
    scans = scan_map(evidence(window, [*frame, "offset"], grid))
    far = F.abs("offset")
    sums = {w: F.sum(F.when(far <= w, F.pow(F.lit(decay), far) * F.col("value"))) for w in windows}
    fused = scans.groupBy(*frame, *CELL).agg(*(s.alias(f"w{w}") for w, s in sums.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"w{w}").alias("value")) for w in windows)))
    # least() and greatest() skip NULLs, so cells that a narrower window doesn't touch go first
    out = fused.select(*FRAME, *CELL, rows.alias("s")).filter("s.value is not null").select(*FRAME, *CELL, "s.w", clamped("s.value"))
    return out.withColumn("p", g.probability(F.col("value")))


def upsample(maps: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor cells of the same value."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = maps.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    return out.withColumns({"row": F.col("row") * factor + F.col("_r"), "col": F.col("col") * factor + F.col("_c")}).drop("_r", "_c")
