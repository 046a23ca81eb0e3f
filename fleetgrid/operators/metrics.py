"""How well a map agrees with boxes and with the scan itself. A score that isn't defined is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.rays import probes
from ..grid import CELL, FRAME, Grid
from .boxes import mask_rows, masks, words_of_row
from .tier1 import dealt


def occupied_cells(maps: DataFrame, threshold: float = 0.5) -> DataFrame:
    return maps.filter(g.occupied(F.col("p"), threshold)).select(*FRAME, *CELL)


def box_hits(maps: DataFrame, box_cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``frame key, box_id, n_box, n_hit``: a box's cells, and those of them that are occupied. Boxes without cells are left out."""
    hit = occupied_cells(maps, threshold).withColumn("hit", F.lit(1))
    joined = box_cells.join(hit, [*FRAME, *CELL], "left")
    return joined.groupBy(*FRAME, "box_id").agg(F.count("*").alias("n_box"), F.count("hit").alias("n_hit"))


def iobb(maps: DataFrame, box_cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``iobb`` (mean over boxes of occupied over all cells) and ``n_objects`` of each frame that has a box with cells."""
    return mean_share(box_hits(maps, box_cells, threshold))


def precision(maps: DataFrame, boxes: DataFrame, box_cells: DataFrame, threshold: float = 0.5, zero_outside: bool = False) -> DataFrame:
    """``precision``: occupied cells inside a box over all occupied cells, for every frame of ``maps``.

    NULL if nothing is occupied or the frame has no box. ``zero_outside``: for labels of which all lie outside the map the
    score is 0, not NULL, as camera-based labels are scored.
    """
    true = box_cells.select(*FRAME, *CELL).distinct().withColumn("true", F.lit(1))
    counts = maps.select(*FRAME, *CELL, g.occupied(F.col("p"), threshold).alias("occ")).join(true, [*FRAME, *CELL], "left")
    counts = counts.groupBy(*FRAME).agg(F.count_if("occ").alias("n_occupied"), F.count_if(F.col("occ") & F.col("true").isNotNull()).alias("n_true"))
    return _precision(counts, boxes, zero_outside)


def _precision(counts: DataFrame, boxes: DataFrame, zero_outside: bool) -> DataFrame:
    labelled = boxes.groupBy(*FRAME).agg(F.count("*").alias("n_boxes"))
    out = counts.join(labelled, FRAME, "left")
    score = F.when((F.col("n_occupied") > 0) & (F.col("n_boxes") > 0), F.col("n_true") / F.col("n_occupied"))
    if zero_outside:
        score = F.when(F.col("n_boxes") > 0, F.coalesce(score, F.lit(0.0)))
    return out.select(*FRAME, "n_occupied", "n_true", score.alias("precision"))


def overlay(maps: DataFrame, boxes: DataFrame, box_cells: DataFrame, grid: Grid = Grid(), threshold: float = 0.5) -> DataFrame:
    """``n_inside`` (boxes whose centre is in the map) and ``n_overlap`` (occupied cells summed over boxes) of each frame."""
    return overlaid(boxes, box_hits(maps, box_cells, threshold), grid)


def overlaid(boxes: DataFrame, counts: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """As overlay, from box_counts or box_hits."""
    inside = (F.abs("cx") <= grid.half) & (F.abs("cy") <= grid.half)
    hits = counts.groupBy(*FRAME).agg(F.sum("n_hit").alias("n_overlap"))
    return boxes.groupBy(*FRAME).agg(F.count_if(inside).alias("n_inside")).join(hits, FRAME, "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0).cast("long")))


def seen_ranges(points: DataFrame, bins: int = 360) -> DataFrame:
    """``frame key, bin, d``: the nearest point on each bearing."""
    return points.groupBy(*FRAME, g.angle_bin(F.col("x"), F.col("y"), bins).alias("bin")).agg(F.min(g.distance(F.col("x"), F.col("y"))).alias("d")).filter("d > 0")


def first_hits(maps: DataFrame, grid: Grid = Grid(), bins: int = 360, threshold: float = 0.5) -> DataFrame:
    """``frame key, bin, d_est``: the first step on each bearing whose cell is occupied.

    The join starts from the few occupied cells; the probes are a fixed table that depends on the grid alone, so it is broadcast.
    """
    steps = F.broadcast(probes(maps.sparkSession, grid, bins))
    return occupied_cells(maps, threshold).join(steps, CELL).groupBy(*FRAME, "bin").agg(F.min("step").alias("d_est"))


def angular_nmse(maps: DataFrame, points: DataFrame, grid: Grid = Grid(), bins: int = 360, threshold: float = 0.5) -> DataFrame:
    """``nmse`` of each frame with points: squared differences between seen range and first occupied step over squared ranges,
    on bearings with a point; bearings without an occupied cell count as the map's border."""
    both = seen_ranges(points, bins).join(first_hits(maps, grid, bins, threshold), [*FRAME, "bin"], "left")
    off = F.col("d") - F.coalesce("d_est", F.lit(grid.half * 1.42))
    return both.groupBy(*FRAME).agg((F.sum(off * off) / F.sum(F.col("d") * F.col("d"))).alias("nmse"), F.count("*").alias("n_bins"))


def packed(maps: DataFrame, grid: Grid = Grid(), threshold: float = 0.5) -> DataFrame:
    """``frame key, bits``: the occupied cells of each map as bits, a row of the map in whole 64-bit words."""
    n = words_of_row(grid)
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("col") % 64)
    bits = F.bit_or(F.when(g.occupied(F.col("p"), threshold), own).otherwise(F.lit(0).cast("long")))
    words = maps.groupBy(*FRAME, (F.col("row") * n + F.floor(F.col("col") / 64)).cast("int").alias("word")).agg(bits.alias("bits"))
    of = words.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n * grid.size - 1)), lambda w: F.coalesce(F.element_at("of", w.cast("int")), F.lit(0).cast("long")))
    return of.select(*FRAME, every.alias("bits"))


def under(bits: DataFrame, boxes: DataFrame, keep: Sequence[str] = ("box_id",), grid: Grid = Grid()) -> DataFrame:
    """``frame key, keep, word, mask, hit``: the cells of each box as bits, word by word, and those of them that are occupied in
    packed maps.

    A map meets its frame's boxes as one row of bits. So boxes are shuffled, never their cells.
    """
    both = boxes.select(*FRAME, *keep, "cx", "cy", "w", "l", "yaw").join(bits, FRAME, "left")
    return mask_rows(both, grid, [*keep, "bits"]).select(*FRAME, *keep, "word", "mask", F.coalesce(F.col("mask").bitwiseAND(F.get("bits", "word")), F.lit(0).cast("long")).alias("hit"))


def box_counts(maps: DataFrame, boxes: DataFrame, grid: Grid = Grid(), threshold: float = 0.5) -> DataFrame:
    """As box_hits, from boxes (with ids) instead of their cells."""
    n = lambda c: F.sum(F.bit_count(c).cast("long"))
    return under(packed(maps, grid, threshold), boxes, grid=grid).groupBy(*FRAME, "box_id").agg(n("mask").alias("n_box"), n("hit").alias("n_hit"))


def mean_share(counts: DataFrame) -> DataFrame:
    """As iobb, from box_counts or box_hits."""
    return counts.groupBy(*FRAME).agg(F.avg(F.col("n_hit") / F.col("n_box")).alias("iobb"), F.count("*").alias("n_objects"))


def box_precision(maps: DataFrame, boxes: DataFrame, labelled: DataFrame, grid: Grid = Grid(), threshold: float = 0.5, zero_outside: bool = False) -> DataFrame:
    """As precision, from boxes instead of their cells; ``labelled``: the rows that say which frames have boxes at all."""
    bits = dealt(packed(maps, grid, threshold))
    true = under(bits, boxes, (), grid).groupBy(*FRAME, "word").agg(F.bit_or("hit").alias("hit"))
    true = true.groupBy(*FRAME).agg(F.sum(F.bit_count("hit").cast("long")).alias("n_true"))
    n = F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    counts = bits.select(*FRAME, n.alias("n_occupied")).join(true, FRAME, "left").fillna(0, ["n_true"])
    return _precision(counts, labelled, zero_outside)


def scores(maps: DataFrame, points: DataFrame, boxes: DataFrame, grid: Grid = Grid(), bins: int = 360, threshold: float = 0.5) -> DataFrame:
    """All scores of each frame's map in one row: ``nmse, iobb, n_objects, n_occupied, precision``, as the functions above give them.

    A frame is one row: its map as bits, its boxes and all of them together as masks over them (a frame has few), and the nearest point on each
    bearing. Scores count bits under masks and look bits up along bearings, so the map is made once and no cells are joined or shuffled.
    """
    n = words_of_row(grid)
    seen = seen_ranges(points, bins).groupBy(*FRAME).agg(F.collect_list(F.struct("bin", "d")).alias("seen"))
    # boxes are told apart by their place among their frame's
    told = boxes.groupBy(*FRAME).agg(F.collect_list(F.struct("cx", "cy", "w", "l", "yaw")).alias("of")).select(*FRAME, F.posexplode("of").alias("nth", "box")).select(*FRAME, "nth", "box.*")
    boxed = masks(told, grid, ["nth"]).groupBy(*FRAME).agg(F.collect_list("words").alias("boxes"))
    truth = mask_rows(boxes, grid, ()).groupBy(*FRAME, "word").agg(F.bit_or("mask").alias("mask")).groupBy(*FRAME).agg(F.collect_list(F.struct("word", "mask")).alias("truth"))
    steps = probes(maps.sparkSession, grid, bins).groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("step", (F.col("row") * n + F.floor(F.col("col") / 64)).cast("int").alias("word"), (F.col("col") % 64).alias("bit")))).alias("of"))
    # one row, whose size depends on the grid alone
    steps = steps.groupBy().agg(F.sort_array(F.collect_list(F.struct("bin", "of"))).alias("steps"))
    rows = packed(maps, grid, threshold).join(seen, FRAME).join(boxed, FRAME, "left").join(truth, FRAME, "left").crossJoin(F.broadcast(steps))

    zero, bits = F.lit(0).cast("long"), F.col("bits")
    total = lambda xs, of: F.aggregate(xs, zero, lambda a, x: a + of(x))
    under = lambda w: F.bit_count(w["mask"].bitwiseAND(F.get(bits, w["word"]))).cast("long")
    counts = F.transform("boxes", lambda ws: F.struct(total(ws, under).alias("hit"), total(ws, lambda w: F.bit_count(w["mask"]).cast("long")).alias("all")))
    objects = F.filter(counts, lambda b: b["all"] > 0)
    n_true = F.coalesce(total("truth", under), zero)

    def first_step(b: Column) -> Column:
        along = F.get(F.col("steps"), b)["of"]
        hit = F.array_position(F.transform(along, lambda p: F.getbit(F.get(bits, p["word"]), p["bit"]).cast("int")), 1)
        return F.when(hit > 0, F.get(along, (hit - 1).cast("int"))["step"]).otherwise(F.lit(grid.half * 1.42))

    off = F.transform("seen", lambda s: F.struct((s["d"] - first_step(s["bin"])).alias("off"), s["d"].alias("d")))
    squares = F.aggregate(off, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda a, x: F.struct((a["a"] + x["off"] * x["off"]).alias("a"), (a["b"] + x["d"] * x["d"]).alias("b")))
    out = rows.select(*FRAME, squares.alias("squares"), objects.alias("objects"), F.size("boxes").alias("n_boxes"), total(bits, lambda b: F.bit_count(b).cast("long")).alias("n_occupied"), n_true.alias("n_true"))
    shares = F.aggregate("objects", F.lit(0.0), lambda a, b: a + b["hit"] / b["all"])
    has = F.size("objects") > 0
    return out.select(
        *FRAME,
        (F.col("squares.a") / F.col("squares.b")).alias("nmse"),
        F.when(has, shares / F.size("objects")).alias("iobb"),
        F.when(has, F.size("objects").cast("long")).alias("n_objects"),
        "n_occupied",
        F.when((F.col("n_occupied") > 0) & (F.col("n_boxes") > 0), F.col("n_true") / F.col("n_occupied")).alias("precision"),
    )
