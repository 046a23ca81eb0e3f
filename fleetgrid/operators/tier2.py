"""Sparse maps by pattern-coupled Bayesian learning: measurement rows, and one solve a frame as a grouped job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.rays import ray
from ..grid import CELL, FRAME, Grid
from .reports import sweep
from .solver import Settings, solve_all
from .tier1 import dealt

#: Solves that a task makes and sends at once, and rays that they have together, but for a map that has more.
SOLVES, RAYS = 32, 4000


def closest_hits(points: DataFrame, key: Sequence[str] = FRAME, hits: int = 3, bins: int = 360) -> DataFrame:
    """The ``hits`` nearest points of each bearing; equal ranges go by x, then y. Spark drops the rest before it shuffles."""
    out = points.withColumn("bin", g.angle_bin(F.col("x"), F.col("y"), bins)).withColumn("range", g.distance(F.col("x"), F.col("y")))
    order = Window.partitionBy(*key, "bin").orderBy("range", "x", "y")
    return out.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= hits)


def measurement_rows(kept: DataFrame, key: Sequence[str] = FRAME, free_weight: float = 0.5, grid: Grid = Grid(), scale: Column | None = None) -> DataFrame:
    """``key, kind, row, col, weight, y, n``: the sparse linear model of the kept hits, with equal entries counted.

    A hit gives an occupied row (its cell, weight 1, target 1) and a free row (every cell of its ray, its own included, weight
    ``free_weight``, target 0); ``hit_row, hit_col`` tell rows apart. ``scale`` multiplies weights and targets.
    """
    factor = F.lit(1.0) if scale is None else scale
    line = F.explode(ray(F.col("row"), F.col("col"), F.lit(grid.ego[0]), F.lit(grid.ego[1])))
    base = kept.groupBy(*key, *CELL, factor.alias("scale")).agg(F.count("*").alias("n"))
    occupied = base.select(*key, F.lit("occupied").alias("kind"), F.col("row").alias("hit_row"), F.col("col").alias("hit_col"), *CELL, F.col("scale").alias("weight"), F.col("scale").alias("y"), "n")
    free = base.select(*key, "scale", "n", F.col("row").alias("hit_row"), F.col("col").alias("hit_col"), line.alias("c"))
    free = free.select(*key, F.lit("free").alias("kind"), "hit_row", "hit_col", "c.row", "c.col", (F.col("scale") * free_weight).alias("weight"), F.lit(0.0).alias("y"), "n")
    return occupied.unionByName(free)


def _schema(key: Sequence[str], source: DataFrame) -> T.StructType:
    cell = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("mu", "alpha"))])
    return T.StructType(
        [
            *(source.schema[k] for k in key),
            T.StructField("cells", T.ArrayType(cell)),
            T.StructField("iters", T.IntegerType()),
            T.StructField("converged", T.BooleanType()),
            T.StructField("conv_history", T.ArrayType(T.DoubleType())),
            T.StructField("error", T.StringType()),
        ]
    )


class Defaults(NamedTuple):
    """Settings that a row may carry as columns, to solve a frame under several of them."""

    beta: float = 1.0
    gamma: float = 30.0
    free_weight: float = 0.5
    max_iter: int = 150


def pcsbl_map(kept: DataFrame, key: Sequence[str] = FRAME, settings: Settings = Settings(), grid: Grid = Grid(), tile: Grid | None = None) -> DataFrame:
    """``key, cells, iters, converged, conv_history, error``: one solve for each key.

    ``kept`` has a row for each hit (row, col; ``scale`` if weighted; ``n_points`` with the points seen, as fewer than 5
    give an empty map). Columns named as fields of Defaults set that parameter by key. A solve that fails gives NULLs and an error.
    Hits are reduced to counted cells before Python sees them, one row a key with some hundred cells; keys come in batches, and a task
    holds a few solved maps at a time.
    """
    given = [c for c in Defaults._fields if c in kept.columns]
    extra = [c for c in ("ego_row", "ego_col") if c in kept.columns]
    scale = F.col("scale") if "scale" in kept.columns else F.lit(1.0)
    rest = [c for c in [*given, *extra, "n_points"] if c not in key]
    hits = kept.groupBy(*key, *rest, *CELL).agg(F.sum(scale * scale).alias("h"), F.count("*").cast("double").alias("count"), F.sum(F.when(scale > 0.5, scale * scale).otherwise(0.0)).alias("start"))
    # a frame's rows are few bytes but seconds of work, so partitions must not be coalesced by size; any key is told apart without its constant dataset
    by = dealt(hits, [k for k in key if k != "dataset"]).groupBy(*key)
    rows = by.agg(*(F.first(c).alias(c) for c in rest), F.collect_list(F.struct(*CELL, "h", "count", "start")).alias("hits"))
    own = tile or grid
    cell = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("mu", pa.float64()), ("alpha", pa.float64())])

    def solved(group: list[tuple]) -> list[tuple]:
        """Solves with the same settings, together; one by one if that fails, so that only those that fail have an error."""
        try:
            found = solve_all([hits for _, hits, _, _ in group], [n for _, _, n, _ in group], own.size, [ego for *_, ego in group], group[0][0])
            return [(f, None) for f in found]
        except (ArithmeticError, ValueError) as e:
            return [(None, str(e))] if len(group) == 1 else [solved([g])[0] for g in group]

    def told(first: dict) -> tuple:
        s = settings._replace(**{c: type(getattr(Defaults(), c))(first[c]) for c in given})
        return s, int(first["n_points"]), (int(first["ego_row"]), int(first["ego_col"])) if extra else own.ego

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # maps that are solved together are about as large, and have the same settings
            sizes = np.asarray(batch.column("hits").value_lengths())
            same = np.asarray(pa.array([str([r[c] for c in given]) for r in batch.select(given).to_pylist()] if given else [""] * len(sizes)).dictionary_encode().indices)
            order = np.lexsort((sizes, same))
            a = 0
            while a < len(order):
                n = 1 + int(np.searchsorted(np.cumsum(sizes[order[a : a + SOLVES]]), RAYS))
                take = order[a : a + min(n, SOLVES)]
                take = take[same[take] == same[take[0]]]
                a += len(take)
                part = batch.take(pa.array(take))
                lists = part.column("hits")
                ends = np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
                columns = [np.asarray(c) for c in lists.flatten().flatten()]
                found, group = [(None, None)] * len(take), []
                for i, r in enumerate(part.drop_columns("hits").to_pylist()):
                    try:
                        s, n, ego = told(r)
                        group.append((i, (s, [c[ends[i] : ends[i + 1]] for c in columns], n, ego)))
                    except (ArithmeticError, ValueError) as e:
                        found[i] = (None, str(e))
                for (i, _), f in zip(group, solved([g for _, g in group]) if group else [], strict=True):
                    found[i] = f
                cells = [(f.touched // f.size, f.touched % f.size, f.mu[f.touched], f.alpha[f.touched]) if f else ([],) * 4 for f, _ in found]
                starts = pa.array(np.r_[0, np.cumsum([len(c[0]) for c in cells])].astype(np.int32))
                values = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*cells, strict=True), cell, strict=True)], fields=list(cell))
                made = pa.ListArray.from_arrays(starts, values, mask=pa.array([f is None for f, _ in found]))
                of = lambda name, kind: pa.array([getattr(f, name) if f else None for f, _ in found], kind)
                rest_of = [of("iters", pa.int32()), of("converged", pa.bool_()), of("history", pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), made, *rest_of], names=[*key, "cells", "iters", "converged", "conv_history", "error"])

    return rows.mapInArrow(run, _schema(key, rows))


def solved_cells(solved: DataFrame, key: Sequence[str] = FRAME) -> DataFrame:
    """``key, row, col, mu, alpha, p``: the touched cells of solved maps; others are 0."""
    out = solved.select(*key, F.explode("cells").alias("c")).select(*key, "c.*")
    return out.withColumn("p", g.clipped(F.col("mu")).cast("float"))


def counted_hits(points: DataFrame, key: Sequence[str], hits: int, bins: int, by: Sequence[str] | None = None, least: int = 0) -> DataFrame:
    """The closest hits of each ``by`` (``key`` if not given), with ``n_points``, the number of all points of their key.

    The points are cut to their closest hits where they are, before anything is shuffled, and the counts come from a
    group-by of their own, which sends a row for each key and task. Keys with fewer than ``least`` points are left out.
    """
    n = points.groupBy(*key).agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= least)
    return closest_hits(points, by or key, hits, bins).join(n, list(key))


def frame_maps(points: DataFrame, settings: Settings = Settings(), grid: Grid = Grid(), hits: int = 3, bins: int = 360) -> DataFrame:
    """One map for each frame."""
    return pcsbl_map(counted_hits(points, FRAME, hits, bins), settings=settings, grid=grid)


def sector_maps(points: DataFrame, sectors: int, settings: Settings = Settings(), grid: Grid = Grid(), hits: int = 3, bins: int = 360) -> DataFrame:
    """A solve for each frame and sector, merged by the largest value of a cell: ``frame key, row, col, p``.

    Sectors with fewer than 3 points are skipped, and fewer than 5 give an empty map anyway.
    """
    key = [*FRAME, "sector"]
    dealt = points.withColumn("sector", g.sector(F.col("x"), F.col("y"), sectors))
    solved = pcsbl_map(counted_hits(dealt, key, hits, bins, least=3), key, settings, grid)
    # a sector's map is sent as one row, and a frame's are merged in Arrow batches: cells aren't shuffled or held in a table of a task's cells
    maps = solved.groupBy(*FRAME).agg(F.flatten(F.collect_list("cells")).alias("_cells"))
    return maps.select(*FRAME, F.inline(F.arrow_udf(_largest, "array<struct<row:int,col:int,p:float>>")("_cells")))


def _largest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The largest value of each cell of each map, of cells that may come several times; a few maps are laid out at a time."""
    for batch in batches:
        for a in range(0, len(batch), SOLVES):
            maps = batch.slice(a, SOLVES)
            row, col, mu, _ = (np.asarray(c) for c in maps.flatten().flatten())
            if not len(row):
                yield pa.array([[]] * len(maps), pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("p", pa.float32())])))
                continue
            high, wide = int(row.max()) + 1, int(col.max()) + 1
            most = np.full(len(maps) * high * wide, -1, dtype=np.float32)
            which = np.repeat(np.arange(len(maps)), np.asarray(maps.value_lengths()))
            # as clipped(): NaN is above all numbers
            np.maximum.at(most, (which * high + row) * wide + col, np.where(np.isnan(mu), 1.0, np.clip(mu, 0, 1)).astype(np.float32))
            at = np.flatnonzero(most >= 0)
            of, cell = np.divmod(at, high * wide)
            ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(maps)))].astype(np.int32)
            values = [pa.array((cell // wide).astype(np.int32)), pa.array((cell % wide).astype(np.int32)), pa.array(most[at])]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=["row", "col", "p"]))


def window_maps(window: DataFrame, decay: float = 0.85, settings: Settings = Settings(), grid: Grid = Grid(), hits: int = 3, bins: int = 360) -> DataFrame:
    """One solve for each frame from the points of its window, rows weighted by decay^|offset|. Hits are picked by frame seen.

    Hits weighted one half or less take part in the solve, but not in where it starts. However few points a window has, it is solved.
    """
    points = counted_hits(window, FRAME, hits, bins, [*FRAME, "offset"]).withColumn("scale", F.pow(F.lit(decay), F.abs("offset")))
    return pcsbl_map(points, settings=settings._replace(least_points=1), grid=grid)


def tile_maps(points: DataFrame, tiles: int, settings: Settings = Settings(), grid: Grid = Grid(), hits: int = 3, bins: int = 360) -> DataFrame:
    """Solves for tiles x tiles parts of the map, stitched: ``frame key, row, col, p``. Kept as an ablation: it harms the map.

    Each tile takes the points within its half width of the vehicle (not of its own centre), and hits and vehicle are
    clipped to the tile.
    """
    size = grid.size // tiles
    part = Grid(size, grid.cell)
    key = [*FRAME, "tile_row", "tile_col"]
    side = F.sequence(F.lit(0), F.lit(tiles - 1))
    own = points.withColumn("tile_row", F.explode(side)).withColumn("tile_col", F.explode(side))
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))
    # the tile's own axes start at its centre
    mid_x = (F.col("tile_col") + 0.5) * size * grid.cell - grid.half
    mid_y = grid.half - (F.col("tile_row") + 0.5) * size * grid.cell
    place = lambda v, mid, down: clip(F.floor(((mid - v) if down else (v - mid)) / grid.cell + size / 2).cast("int"))
    near = own.filter((F.abs("x") <= part.half) & (F.abs("y") <= part.half))
    near = near.withColumns({"row": place(F.col("y"), mid_y, True), "col": place(F.col("x"), mid_x, False), "ego_row": place(F.lit(0.0), mid_y, True), "ego_col": place(F.lit(0.0), mid_x, False)})
    solved = pcsbl_map(counted_hits(near, key, hits, bins), key, settings, grid, part)
    cells = solved_cells(solved, key)
    return cells.select(*FRAME, (F.col("row") + F.col("tile_row") * size).alias("row"), (F.col("col") + F.col("tile_col") * size).alias("col"), "p")


def swept_maps(points: DataFrame, settings: Settings = Settings(), grid: Grid = Grid(), hits: int = 3, bins: int = 360, **swept: Sequence[float]) -> DataFrame:
    """One solve for each frame and combination of the parameters ``swept`` (fields of Defaults and their values).

    Points are cut to their closest hits first; only these are taken once for each combination.
    """
    return pcsbl_map(sweep(counted_hits(points, FRAME, hits, bins), **swept), [*FRAME, *swept], settings, grid)
