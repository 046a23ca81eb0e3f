"""From sensor points to the cells that they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..grid import FRAME, Grid


def with_defaults(frames: DataFrame) -> DataFrame:
    """Frames without calibration get the roof sensor's; frames without pose stand at the origin."""
    flat = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    return frames.withColumns(
        {
            "calib_r": F.coalesce("calib_r", flat(g.IDENTITY)),
            "calib_t": F.coalesce("calib_t", flat((0, 0, g.ROOF))),
            "pose_r": F.coalesce("pose_r", flat(g.IDENTITY)),
            "pose_t": F.coalesce("pose_t", flat((0, 0, 0))),
        }
    )


def transform_to_ego(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points in ego axes, in single precision. Points of unknown frames are left out."""
    joined = points.join(frames.select(*FRAME, "calib_r", "calib_t"), FRAME)
    moved = g.apply(F.col("calib_r"), F.col("calib_t"), [F.col(c).cast("double") for c in "xyz"])
    return joined.withColumns({c: v.cast("float") for c, v in zip("xyz", moved, strict=True)}).drop("calib_r", "calib_t")


def drop_ground(points: DataFrame) -> DataFrame:
    return points.filter(g.above_ground(F.col("z")))


def height_filter(points: DataFrame) -> DataFrame:
    return points.filter(g.height_ok(F.col("z")))


def range_filter(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return points.filter(g.range_ok(F.col("x"), F.col("y"), grid))


def project(points: DataFrame) -> DataFrame:
    """Points seen from above."""
    return points.drop("z")


def discretize(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return points.withColumns({"row": g.row_of(F.col("y"), grid), "col": g.col_of(F.col("x"), grid)})


def preprocess(points: DataFrame, frames: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """All of the above: the points that count, from above, with the cell that each hits. No shuffle but the join to frames."""
    return discretize(project(range_filter(height_filter(transform_to_ego(points, frames)), grid)), grid)
