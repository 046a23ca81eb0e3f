"""Tables over many frames' results: means, comparisons, sweeps and distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..grid import CELL, FRAME, Grid

METRICS = ("nmse", "iobb", "precision")


def with_means(results: DataFrame, by: Sequence[str] = ("method",), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Results by frame, and a row ``is_mean`` = 1 for each group with the means; missing scores don't count."""
    sets = results.groupingSets([[*by, "scene_id", "frame_idx"], [*by]], *by, "scene_id", "frame_idx")
    return sets.agg(F.grouping("frame_idx").cast("int").alias("is_mean"), *(F.avg(m).alias(m) for m in metrics))


def convergence(results: DataFrame) -> DataFrame:
    """Share converged and mean iterations of each method, with the number of frames."""
    return results.groupBy("method").agg(F.count("*").alias("n"), (F.count_if("converged") * 1.0 / F.count("*")).alias("converged_share"), F.avg("iters").alias("mean_iters"))


def iteration_ratio(results: DataFrame) -> DataFrame:
    """Mean iterations without coupling over those with it."""
    mean = lambda beta: F.avg(F.when(F.col("beta") == beta, F.col("iters")))
    return results.agg(mean(0).alias("iters_beta0"), mean(1).alias("iters_beta1"), (mean(0) / F.nullif(mean(1), F.lit(0.0))).alias("ratio"))


def _sides(results: DataFrame, a: str, b: str, metric: str, by: Sequence[str]) -> DataFrame:
    side = lambda m: F.max(F.when(F.col("method") == m, F.col(metric)))
    return results.groupBy(*by).agg(side(a).alias("a"), side(b).alias("b"))


def wins(results: DataFrame, a: str, b: str, metric: str = "nmse") -> DataFrame:
    """Frames on which method ``a`` has the lower score, ``b`` has it, or neither; frames that lack a score don't count."""
    both = _sides(results, a, b, metric, FRAME).filter("a is not null and b is not null")
    return both.agg(F.count_if(F.expr("a < b")).alias("a_wins"), F.count_if(F.expr("b < a")).alias("b_wins"), F.count_if(F.expr("a = b")).alias("ties"))


def relative_change(results: DataFrame, a: str, b: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``metric, a, b, delta, delta_pct``: mean of each method over frames and the change from a to b in percent of a."""
    side = lambda method, m: F.avg(F.when(F.col("method") == method, F.col(m)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), side(a, m).alias("a"), side(b, m).alias("b")) for m in metrics))
    out = results.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return out.withColumn("delta", F.col("b") - F.col("a")).withColumn("delta_pct", F.when(F.col("a") != 0, 100 * (F.col("b") - F.col("a")) / F.col("a")))


def against_baseline(results: DataFrame, setting: str, baseline: object, value: str = "nmse", time: str = "elapsed_s") -> DataFrame:
    """Speed-up and score ratio of each scene's settings against its baseline setting; NULL where there is none."""
    own = Window.partitionBy("scene_id")
    base = lambda c: F.max(F.when(F.col(setting) == baseline, F.col(c))).over(own)
    safe = lambda a, b: F.when(b != 0, a / b)
    return results.withColumn("speedup", safe(base(time), F.col(time))).withColumn("value_ratio", safe(F.col(value), base(value)))


def sweep_table(results: DataFrame, parameter: str, scenes: Sequence[str], value: str = "nmse") -> DataFrame:
    """A row for each parameter value, a column for each scene."""
    return results.groupBy(parameter).pivot("scene_id", list(scenes)).agg(F.avg(value))


def across_datasets(results: DataFrame, datasets: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """``metric, method`` and a column of means for each dataset."""
    long = results.select("dataset", "method", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("s"))
    return long.select("dataset", "method", "s.*").groupBy("metric", "method").pivot("dataset", list(datasets)).agg(F.avg("v"))


def dense(maps: DataFrame, keys: DataFrame, grid: Grid = Grid(), fill: float = 0.5, value: str = "p") -> DataFrame:
    """Every cell of every map of ``keys``; untouched cells get ``fill``."""
    side = F.sequence(F.lit(0), F.lit(grid.size - 1))
    cells = keys.select(*FRAME).distinct().withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    return cells.join(maps.select(*FRAME, *CELL, F.col(value).cast("double").alias(value)), [*FRAME, *CELL], "left").fillna(fill, [value])


def concentration(maps: DataFrame, grid: Grid = Grid(), fill: float = 0.5) -> DataFrame:
    """``p90, mean_top, mean_p, n_occupied`` of each map: the 90th percentile over all cells, the mean above it, the mean of all.

    Equal values of a map are counted first: a scan's map has a few values (by hits, and whether a ray passed). Untouched cells aren't laid
    out: all have the value ``fill``, and are one more count.
    """
    total = grid.size * grid.size
    counts = maps.groupBy(*FRAME, F.col("p").cast("double").alias("p")).agg(F.count("p").alias("n"))
    touched = counts.groupBy(*FRAME).agg((total - F.sum("n")).alias("rest"), F.sum(F.when(F.col("p") > 0.5, F.col("n")).otherwise(0)).cast("int").alias("n_occupied"), F.collect_list(F.struct("p", "n")).alias("ps"))
    whole = F.concat("ps", F.array(F.struct(F.lit(float(fill)).alias("p"), F.col("rest").alias("n"))))
    touched = touched.select(*FRAME, "n_occupied", F.array_sort(F.filter(whole, lambda x: x["n"] > 0)).alias("ps"))

    def at(i: int) -> Column:
        """The value of rank ``i`` from below."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("p"))
        there = lambda s, x: (s["seen"] <= i) & (s["seen"] + x["n"] > i)
        return F.reduce("ps", start, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(there(s, x), x["p"]).otherwise(s["p"]).alias("p")))["p"]

    place = 0.9 * (total - 1)
    i, part = int(place), place - int(place)
    # no sum of two shares, which could miss the value of both by a last digit and so put cells of this value above it
    out = touched.withColumn("p90", at(i) + (at(i + 1) - at(i)) * part)
    out = out.withColumn("top", F.filter("ps", lambda x: x["p"] > F.col("p90")))
    number = lambda xs: F.reduce(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    add = lambda xs: F.reduce(xs, F.lit(0.0), lambda a, x: a + x["p"] * x["n"])
    return out.select(
        *FRAME,
        "p90",
        F.when(number("top") > 0, add("top") / number("top")).alias("mean_top"),
        (add("ps") / total).alias("mean_p"),
        "n_occupied",
    )


QUARTILES = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}


def summary(results: DataFrame, by: str = "method", value: str = "nmse", accuracy: int = 1000) -> DataFrame:
    """Quartiles and extremes of a score for each method, from a summary of bounded size that tasks merge.

    Each is a score of the table whose rank is off by n / ``accuracy`` at most.
    """
    found = F.percentile_approx(value, F.array(*(F.lit(q) for q in QUARTILES.values())), accuracy)
    out = results.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), found.alias("q"))
    return out.select(by, "n", *(F.col("q")[i].alias(name) for i, name in enumerate(QUARTILES)))


def distribution(results: DataFrame, by: str = "method", value: str = "nmse", accuracy: int = 1000) -> DataFrame:
    """Exact quartiles and extremes of a score for each method, between two scores where they fall between them.

    A first pass gives, by a summary of bounded size, two scores around each quartile; a second counts the scores below and, one by one, those
    between them, about 4 n / ``accuracy``. So no task holds the scores of a method. Scores that are NULL don't count; a
    method without any has NULLs.
    """
    scores = results.select(by, F.col(value).cast("double").alias("v"))
    known = scores.filter("v is not null and not isnan(v)")
    # the rank of a summary's score is off by n / accuracy at most, so these lie on either side of the quartile
    shares = [s for q in QUARTILES.values() for s in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    around = known.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", F.array(*(F.lit(s) for s in shares)), accuracy).alias("q"))
    # the summary knows the ends, but for its own error there
    ends = [(F.col("low") if q == 0 else F.col("q")[2 * i], F.col("high") if q == 1 else F.col("q")[2 * i + 1]) for i, q in enumerate(QUARTILES.values())]
    place = [F.lit(q) * (F.col("n") - 1) for q in QUARTILES.values()]
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), p.alias("place"), a.alias("a"), b.alias("b")) for i, (p, (a, b)) in enumerate(zip(place, ends, strict=True)))))
    asked = around.select(by, "n", asked.alias("s")).select(F.col(by).alias("_by"), "n", "s.*")
    # scores below and above a bracket are counted as one, by their nearest
    side = F.when(F.col("v") < F.col("a"), -1).when(F.col("v") <= F.col("b"), 0).otherwise(1)
    near = known.join(asked, known[by].eqNullSafe(asked["_by"])).withColumn("side", side)
    counts = near.groupBy("_by", "i", "place", "side", F.when(F.col("side") == 0, F.col("v")).alias("own")).agg(F.count("*").alias("k"), F.max("v").alias("most"), F.min("v").alias("least"))
    counts = counts.withColumn("v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    upto = F.sum("k").over(Window.partitionBy("_by", "i").orderBy("v"))
    ranked = counts.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("k") + 1)
    of = lambda rank: F.when(F.col("side") < 0, F.col("last") == rank).when(F.col("side") > 0, F.col("first") == rank).otherwise((F.col("first") <= rank) & (F.col("last") >= rank))
    at = lambda rank: F.max(F.when(of(rank), F.col("v")))
    part = F.first(F.col("place") - F.floor("place"))
    found = ranked.groupBy("_by", "i").agg((at(F.floor("place")) * (1 - part) + at(F.ceil("place")) * part).alias("q"))
    wide = found.groupBy("_by").agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(QUARTILES)))
    every = scores.groupBy(by).agg(F.count("v").alias("n"))
    return every.join(wide, every[by].eqNullSafe(wide["_by"]), "left").select(by, "n", *QUARTILES)


def histogram(maps: DataFrame, bins: int = 50) -> DataFrame:
    """``bin, n``: touched cells by probability, in equal bins over [0, 1]."""
    b = F.least(F.floor(F.col("p").cast("double") * bins).cast("int"), F.lit(bins - 1))
    return maps.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def difference(a: DataFrame, b: DataFrame, fill: float = 0.5) -> DataFrame:
    """``diff`` = p of map a less p of map b on each cell that either touches."""
    # either map sends its cells to one aggregate, so nothing is sorted for a join, and a task's part has a bound however large the maps are
    side = lambda m, a, b: m.select(*FRAME, *CELL, *(c.cast("double").alias(n) for c, n in ((a, "pa"), (b, "pb"))))
    both = side(a, F.col("p"), F.lit(None)).unionByName(side(b, F.lit(None), F.col("p")))
    one = both.groupBy(*FRAME, *CELL).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return one.select(*FRAME, *CELL, (F.coalesce("pa", F.lit(fill)) - F.coalesce("pb", F.lit(fill))).alias("diff"))


def smoothed(maps: DataFrame, grid: Grid = Grid(), sigma: float = 0.8, fill: float = 0.5) -> DataFrame:
    """Maps under a Gaussian filter of ``sigma`` cells, cut at int(4 sigma + 0.5) cells and reflected at the border, within [0, 1].

    Only cells near a touched one differ from ``fill``; others are absent. A map's touched cells are one row, and a task lays out a few maps
    at a time and multiplies them from either side; no cell is sent to its neighbours by way of a shuffle.
    """
    n, radius = grid.size, int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    side = np.zeros((n, n))
    for u in range(n):
        for d in range(-radius, radius + 1):
            v = -1 - (u + d) if u + d < 0 else 2 * n - 1 - (u + d) if u + d >= n else u + d
            if 0 <= v < n:
                side[u, v] += raw[d + radius] / sum(raw)
    reach, some = (side > 0).astype(float), max(1, 200_000 // n**2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, some):
                part = batch.slice(a, some)
                lists = part.column("touched")
                which = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                row, col, x = (np.asarray(c) for c in lists.flatten().flatten())
                laid, there = np.zeros((2, len(lists), n, n))
                laid[which, row, col], there[which, row, col] = x, 1
                at = np.nonzero(reach @ there @ reach.T > 0)
                values = [pa.array(at[1].astype(np.int32)), pa.array(at[2].astype(np.int32)), pa.array((side @ laid @ side.T)[at])]
                ends = np.r_[0, np.cumsum(np.bincount(at[0], minlength=len(lists)))].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=["row", "col", "x"]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in FRAME), cells], names=[*FRAME, "cells"])

    touched = maps.groupBy(*FRAME).agg(F.collect_list(F.struct(*CELL, (F.col("p").cast("double") - fill).alias("x"))).alias("touched"))
    kinds = {f.name: f.dataType.simpleString() for f in touched.schema}
    out = touched.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in FRAME) + ", cells array<struct<row:int,col:int,x:double>>")
    return out.select(*FRAME, F.inline("cells")).select(*FRAME, *CELL, g.clipped(F.col("x") + fill).alias("p"))


def trace(solved: DataFrame) -> DataFrame:
    """``iteration, rel_change, step`` of each solve from its history; step is the change of rel_change to the one before."""
    out = solved.select(*FRAME, "beta", F.posexplode("conv_history").alias("i", "rel_change")).withColumn("iteration", F.col("i") + 1).drop("i")
    own = Window.partitionBy(*FRAME, "beta").orderBy("iteration")
    return out.withColumn("step", F.col("rel_change") - F.lag("rel_change").over(own))


def sweep(frames: DataFrame, **values: Sequence[float]) -> DataFrame:
    """Every frame with every combination of parameter values; the lists are given, so nothing is joined."""
    out = frames
    for name, xs in values.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(x) for x in xs))))
    return out
