"""Annotated boxes on the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..grid import CELL, FRAME, Grid


def to_ego_offset(boxes: DataFrame, frames: DataFrame, align_heading: bool = False) -> DataFrame:
    """Boxes in world coordinates as seen from their frame's position: shifted, and turned only with ``align_heading``.

    The default leaves boxes in the world's axes, as the published scores do, although maps are in the vehicle's axes.
    """
    out = boxes.join(frames.select(*FRAME, "pose_r", "pose_t"), FRAME)
    dx, dy = F.col("cx") - F.col("pose_t")[0], F.col("cy") - F.col("pose_t")[1]
    if align_heading:
        r = F.col("pose_r")
        out = out.withColumns({"cx": r[0] * dx + r[3] * dy, "cy": r[1] * dx + r[4] * dy, "yaw": F.col("yaw") - F.atan2(r[3], r[0])})
    else:
        out = out.withColumns({"cx": dx, "cy": dy})
    return out.drop("pose_r", "pose_t")


def camera_boxes(labels: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Labels in camera coordinates (x, z, w, l, rotation_y) as boxes from above; centres outside the map are left out."""
    out = labels.withColumns({"cx": F.col("x").cast("double"), "cy": F.col("z").cast("double"), "yaw": F.col("rotation_y").cast("double")})
    return out.filter((F.abs("cx") <= grid.half) & (F.abs("cy") <= grid.half))


def box_corners(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("corners", g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("l"), F.col("yaw")))


def _rows(boxes: DataFrame, grid: Grid, keep: Sequence[str], every: bool = False) -> DataFrame:
    """``frame key, keep, row, first, last``: for each row of cells that a box reaches, the columns whose centres lie strictly inside the
    box. Rows without any have NULLs, as with ``every`` has a box that reaches none. A row of cells is a row of the table, so that Spark compiles its numbers, which it wouldn't in lists.

    In a row, either pair of a box's sides leaves an interval of columns; the interval that both leave is found in closed form. Its
    ends may be off by the last digit, so the cells next to them are asked whether they are inside; if none is, the row has none.
    """
    reach = F.sqrt(F.col("w") * F.col("w") + F.col("l") * F.col("l")) / 2
    low, high = (F.floor((grid.half - F.col("cy") + side) / grid.cell).cast("int") for side in (-reach, reach))
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(grid.size - 1))
    box = F.struct("cx", "cy", F.cos("yaw").alias("c"), F.sin("yaw").alias("s"), (F.col("l") / 2).alias("half_l"), (F.col("w") / 2).alias("half_w"), low.alias("low"), high.alias("high"))
    near = boxes.select(*FRAME, *keep, F.inline(F.array(box)))
    near = near.select("*", (F.explode_outer if every else F.explode)(F.when(F.col("low") <= F.col("high"), F.sequence("low", "high"))).alias("row"))
    c, s, half_l, half_w, dy = (F.col(n) for n in ("c", "s", "half_l", "half_w", "dy"))
    near = near.withColumn("dy", grid.half - (F.col("row") + 0.5) * grid.cell - F.col("cy"))
    wide = F.lit(2.0) * grid.size * grid.cell
    # |dx c + dy s| < l / 2 and |dy c - dx s| < w / 2 as bounds of dx; where a factor is 0, dx has no bound by it
    along = [F.when(c != 0, (side - dy * s) / c) for side in (-half_l, half_l)]
    across = [F.when(s != 0, (dy * c - side) / s) for side in (-half_w, half_w)]
    least = F.greatest(*(F.coalesce(F.least(*ends), -wide) for ends in (along, across)), -wide)
    most = F.least(*(F.coalesce(F.greatest(*ends), wide) for ends in (along, across)), wide)
    at = lambda dx: F.least(F.greatest((dx + F.col("cx") + grid.half) / grid.cell, F.lit(-2.0)), F.lit(grid.size + 2.0)) - 0.5
    ends = F.struct(F.ceil(at(least)).cast("int").alias("start"), F.floor(at(most)).cast("int").alias("stop"))
    near = near.select("*", F.inline(F.array(ends)))

    def inside(col: Column) -> Column:
        dx = (col + 0.5) * grid.cell - grid.half - F.col("cx")
        return (F.abs(dx * c + dy * s) < half_l) & (F.abs(dy * c - dx * s) < half_w)

    first, last = (F.coalesce(*(F.when(inside(F.col(end) + k), F.col(end) + k) for k in by)) for end, by in (("start", (-1, 0, 1)), ("stop", (1, 0, -1))))
    near = near.select(*FRAME, *keep, "row", F.inline(F.array(F.struct(first.alias("first"), last.alias("last")))))
    crosses = (F.col("last") >= 0) & (F.col("first") < grid.size)
    within = lambda v: F.when(crosses, F.least(F.greatest(F.col(v), F.lit(0)), F.lit(grid.size - 1))).alias(v)
    return near.select(*FRAME, *keep, "row", within("first"), within("last"))


def rasterize(boxes: DataFrame, grid: Grid = Grid(), keep: Sequence[str] = ("box_id",)) -> DataFrame:
    """``frame key, keep, row, col``: cells whose centre lies strictly inside a box (centre from the ego, yaw). No other cell is made."""
    some = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last"))
    return _rows(boxes, grid, keep).select(*FRAME, *keep, "row", F.explode(some).alias("col"))


def mask_rows(boxes: DataFrame, grid: Grid = Grid(), keep: Sequence[str] = ("box_id",), every: bool = False) -> DataFrame:
    """``frame key, keep, word, mask``: the cells of each box as bits, word by word as in packed maps. No other word is made, but with
    ``every`` a box without cells has rows of NULLs."""
    some = F.when(F.col("first") <= F.col("last"), F.sequence(F.floor(F.col("first") / 64).cast("int"), F.floor(F.col("last") / 64).cast("int")))
    words = _rows(boxes, grid, keep, every).select(*FRAME, *keep, "row", "first", "last", (F.explode_outer if every else F.explode)(some).alias("k"))
    first, last = F.greatest(F.col("first") - 64 * F.col("k"), F.lit(0)), F.least(F.col("last") - 64 * F.col("k"), F.lit(63))
    ones = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - (last - first)), first)
    return words.select(*FRAME, *keep, (F.col("row") * words_of_row(grid) + F.col("k")).alias("word"), F.when(F.col("k").isNotNull(), ones).alias("mask"))


def masks(boxes: DataFrame, grid: Grid = Grid(), keep: Sequence[str] = ("box_id",)) -> DataFrame:
    """``frame key, keep, words``: the cells of each box (told apart by ``keep``) as an array of ``word, mask``; a box without cells has none."""
    word = F.when(F.col("mask").isNotNull(), F.struct("word", "mask"))
    return mask_rows(boxes, grid, keep, every=True).groupBy(*FRAME, *keep).agg(F.collect_list(word).alias("words"))


def words_of_row(grid: Grid) -> int:
    """64-bit words that hold a row of a packed map."""
    return -(-grid.size // 64)


def truth_map(cells: DataFrame) -> DataFrame:
    """Cells inside any box."""
    return cells.select(*FRAME, *CELL).distinct()
