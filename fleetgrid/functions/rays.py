"""Cells that a ray crosses, and the fixed probes that look for the first occupied cell along each bearing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import CELL, EVIDENCE, LIMIT, Grid

#: Scans that are laid out, and rays that are drawn, at a time.
_SCANS, _RAYS = 16, 512


def ray(row: Column, col: Column, ego_row: Column, ego_col: Column) -> Column:
    """Array of (row, col, i, m) from the ego cell (i = 0) to the hit cell (i = m), both included."""
    m = length(row, col, ego_row, ego_col)
    return F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(*(c.alias(n) for n, c in zip(CELL, cell_at(row, col, ego_row, ego_col, i, m), strict=True)), i.alias("i"), m.alias("m")))


def along_rays(hits: DataFrame, row: str, col: str, ego_row: str, ego_col: str) -> DataFrame:
    """The hit cells (by the columns named) with a row for each cell of their rays: ``i, m``, and ``at_row, at_col``. The same cells as
    ``ray``; a list has the steps alone, and cells are worked out as columns, which Spark compiles."""
    ends = [F.col(c) for c in (row, col, ego_row, ego_col)]
    m = length(*ends)
    out = hits.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(i.alias("i"), m.alias("m"))))).select("*", "_s.i", "_s.m").drop("_s")
    at = cell_at(*ends, F.col("i"), F.col("m"))
    return out.withColumns({"at_row": at[0], "at_col": at[1]})


def merged_rays(hits: DataFrame, key: Sequence[str], row: str, col: str, ego_row: str, ego_col: str, n: str) -> DataFrame:
    """``key, row, col, n_hits, is_free``: the cells that the rays of a ``key`` touch, each once. ``hits``: a row for each hit cell, with
    its ``n`` points; one whose row or column isn't known is left out. The same cells as ``ray``.

    A key's hits are one row, and rays are drawn into the key's map, some at a time; so a task holds a batch of keys' hits and a few maps,
    never a table of all rays' cells.
    """
    hits = hits.dropna(subset=[row, col, ego_row, ego_col])
    hit = F.struct(*(F.col(c).alias(name) for c, name in ((row, "row"), (col, "col"), (ego_row, "ego_row"), (ego_col, "ego_col"), (n, "n"))))
    scans = hits.groupBy(*key).agg(F.collect_list(hit).alias("_hits"))
    drawn = F.arrow_udf(_drawn, "array<struct<row:int,col:int,n_hits:bigint,is_free:boolean>>")
    out = scans.select(*key, F.inline(drawn("_hits")))
    return out.select(*key, "row", "col", "n_hits", F.col("is_free").cast("int").alias("is_free"))


def _drawn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The touched cells of scans, from their hits. A few scans are laid out at a time."""
    for batch in batches:
        for a in range(0, len(batch), _SCANS):
            yield _touched(batch.slice(a, _SCANS))


def _touched(scans: pa.Array) -> pa.Array:
    which = np.repeat(np.arange(len(scans)), np.asarray(scans.value_lengths()))
    row, col, ego_row, ego_col, n = (np.asarray(c).astype(np.int64) for c in scans.flatten().flatten())
    free, found, (top, left, high, wide) = _laid_out(which, len(scans), row, col, ego_row, ego_col, n)
    at = np.nonzero(free | (found > 0))[0]
    scan, cell = np.divmod(at, high * wide)
    r, c = np.divmod(cell, wide)
    ends = np.r_[0, np.cumsum(np.bincount(scan, minlength=len(scans)))].astype(np.int32)
    values = [pa.array((r + top).astype(np.int32)), pa.array((c + left).astype(np.int32)), pa.array(found[at]), pa.array(free[at])]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=["row", "col", "n_hits", "is_free"]))


def _laid_out(which: np.ndarray, scans: int, row: np.ndarray, col: np.ndarray, ego_row: np.ndarray, ego_col: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """Whether a ray passes each cell of each scan, and the points in it; the maps' first row and column, rows and columns."""
    # the least map that holds all cells; a cell's number in it, after the scans before
    top, left = min(row.min(), ego_row.min()), min(col.min(), ego_col.min())
    high, wide = max(row.max(), ego_row.max()) - top + 1, max(col.max(), ego_col.max()) - left + 1
    number = lambda r, c: (which * high + r - top) * wide + c - left
    free, found = np.zeros(scans * high * wide, bool), np.zeros(scans * high * wide, np.int64)
    np.add.at(found, number(row, col), n)
    dr, dc = row - ego_row, col - ego_col
    far_r, far_c = np.abs(dr), np.abs(dc)
    m = np.maximum(far_r, far_c)
    # what a step adds on the longer axis (on both, if they are equal), and what a cell of the shorter axis adds
    along = np.where(far_r == m, np.sign(dr) * wide, 0) + np.where(far_c == m, np.sign(dc), 0)
    aside = np.where(far_r < m, np.sign(dr) * wide, 0) + np.where(far_c < m, np.sign(dc), 0)
    lines = np.stack([number(ego_row, ego_col), along, aside, 2 * np.minimum(far_r, far_c), m - 1, 2 * m])
    for b in range(0, len(m), _RAYS):
        steps, part = m[b : b + _RAYS], lines[:, b : b + _RAYS]
        i = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        start, add, off, share, last, double = np.repeat(part, steps, axis=1)
        free[start + i * add + off * ((i * share + last) // double)] = True
    return free, found, (int(top), int(left), int(high), int(wide))


def fused_rays(hits: DataFrame, key: Sequence[str], windows: Sequence[int], decay: float, ego: tuple[int, int]) -> DataFrame:
    """``key, row, col, w, value``: for each half width in ``windows``, the log-odds of the scans at most so far from their ``key``, weighted by
    decay^|offset| and added, of each cell that one of them touches. ``hits``: a row for each hit cell (row, col) of a scan (``offset``), with its
    ``n`` points; one whose row or column isn't known is left out.

    The hits of a key's scans are one row, and rays are drawn into these scans' maps, a few keys' at a time; so a task holds a few keys' maps, and no
    cell of a ray or a scan is a row.
    """
    hit = F.struct(*(F.col(c) for c in ("offset", *CELL, "n")))
    scans = hits.dropna(subset=CELL).groupBy(*key).agg(F.collect_list(hit).alias("_hits"))

    def drawn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a in range(0, len(batch), _SCANS):
                yield _fused(batch.slice(a, _SCANS), list(windows), decay, ego)

    values = ", ".join(f"v{i}:double" for i in range(len(windows)))
    made = F.arrow_udf(drawn, f"array<struct<row:int,col:int,{values}>>")
    # a cell comes once from Python, and its widths become rows after that
    widths = F.stack(F.lit(len(windows)), *(c for i, w in enumerate(windows) for c in (F.lit(w), F.col(f"v{i}")))).alias("w", "value")
    return scans.select(*key, F.inline(made("_hits"))).select(*key, *CELL, widths).filter("value is not null")


def _fused(keys: pa.Array, windows: list[int], decay: float, ego: tuple[int, int]) -> pa.Array:
    of_key = np.repeat(np.arange(len(keys)), np.asarray(keys.value_lengths()))
    offset, row, col, n = (np.asarray(c).astype(np.int64) for c in keys.flatten().flatten())
    seen, at = np.unique(offset, return_inverse=True)
    same = np.full(len(row), 1)
    free, found, (top, left, high, wide) = _laid_out(at * len(keys) + of_key, len(seen) * len(keys), row, col, ego[0] * same, ego[1] * same, n)
    touched = (free | (found > 0)).reshape(len(seen), -1)
    # as scan_log_odds
    value = np.where(found * EVIDENCE >= LIMIT, LIMIT - EVIDENCE * free, EVIDENCE * (found - free)).reshape(len(seen), -1)
    total, any_of, at_width = np.zeros(value.shape[1]), np.zeros(value.shape[1], bool), {}
    before = -1
    for w in sorted(set(windows)):
        for i in np.flatnonzero((np.abs(seen) <= w) & (np.abs(seen) > before)):
            total += decay ** abs(int(seen[i])) * value[i]
            any_of |= touched[i]
        at_width[w], before = (total.copy(), any_of.copy()), w
    cells = np.flatnonzero(any_of)
    key, cell = np.divmod(cells, high * wide)
    ends = np.r_[0, np.cumsum(np.bincount(key, minlength=len(keys)))].astype(np.int32)
    r, c = np.divmod(cell, wide)
    values = [pa.array(v[cells], mask=~known[cells]) for v, known in (at_width[w] for w in windows)]
    values = [pa.array((r + top).astype(np.int32)), pa.array((c + left).astype(np.int32)), *values]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=["row", "col", *(f"v{i}" for i in range(len(windows)))]))


def length(row: Column, col: Column, ego_row: Column, ego_col: Column) -> Column:
    """Steps of a ray."""
    return F.greatest(F.abs(row - ego_row), F.abs(col - ego_col))


def cell_at(row: Column, col: Column, ego_row: Column, ego_col: Column, i: Column, m: Column) -> tuple[Column, Column]:
    """Row and column of step ``i`` of ``m``.

    The line is the integer one: on the longer axis a cell a step, on the other the rounded share, halves towards the ego.
    """

    def along(start: Column, d: Column) -> Column:
        far = F.abs(d)
        share = F.when(far == m, i).otherwise(F.floor((2 * i * far + m - 1) / (2 * m)).cast("int"))
        return start + F.signum(d).cast("int") * share

    return along(ego_row, row - ego_row), along(ego_col, col - ego_col)


def probes(spark: SparkSession, grid: Grid, bins: int = 360, start: float = 1.5) -> DataFrame:
    """``bin, step, row, col``: the cell at each step along the left edge of each bearing. The number of rows depends on the
    grid alone (38,880 for the usual one); steps beyond the map fall on its border cells."""
    n = math.ceil((grid.half * 1.42 - start) / (grid.cell / 2))
    clip = lambda v: min(max(int(v), 0), grid.size - 1)
    rows = []
    for b in range(bins):
        angle = -math.pi + b * (2 * math.pi / bins)
        c, s = math.cos(angle), math.sin(angle)
        for i in range(n):
            step = start + i * (grid.cell / 2)
            rows.append((b, step, clip(math.floor((grid.half - step * s) / grid.cell)), clip(math.floor((step * c + grid.half) / grid.cell))))
    return spark.createDataFrame(rows, "bin int, step double, row int, col int")
