import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgrid.functions import geometry as g
from fleetgrid.functions.rays import ray
from fleetgrid.grid import EVIDENCE, FRAME, Grid
from fleetgrid.operators import boxes, metrics, preprocess, reports, tier1, tier2
from fleetgrid.operators.solver import Layout, Settings, inverse_of, line, solve, solve_all
from fleetgrid.streaming.fold import live_scene_map

FRAMES = "dataset string, scene_id string, frame_idx int, calib_r array<double>, calib_t array<double>, pose_r array<double>, pose_t array<double>"
POINTS = "dataset string, scene_id string, frame_idx int, x double, y double, z double"


def frames(spark, n=1):
    return preprocess.with_defaults(spark.createDataFrame([("d", "s", i, None, [0.0, 0.0, 0.0], None, None) for i in range(n)], FRAMES))


def points(spark, *xyz, frame=0):
    return spark.createDataFrame([("d", "s", frame, *map(float, p)) for p in xyz], POINTS)


def cells(spark, rows):
    return spark.createDataFrame([("d", "s", f, r, c) for f, r, c in rows], "dataset string, scene_id string, frame_idx int, row int, col int")


def test_one_point(spark):
    m = tier1.single_scan_map(preprocess.preprocess(points(spark, (5.1, 0.1, 1.0)), frames(spark)))
    got = {(r["row"], r["col"]): r["value"] for r in m.collect()}
    assert got[39, 50] == pytest.approx(EVIDENCE) and got[40, 40] == pytest.approx(-EVIDENCE) and len(got) == 11


@pytest.mark.parametrize(("n", "alone", "passed"), [(1, 0.8473, 0), (5, 4.2365, 3.3892), (6, 5, 4.1527), (9, 5, 4.1527)])
def test_saturation(spark, n, alone, passed):
    rows = [(0, 40, 50)] * n
    value = lambda extra: tier1.single_scan_map(cells(spark, rows + extra)).filter("row = 40 and col = 50").first()
    assert value([])["value"] == pytest.approx(alone, abs=1e-4)
    crossed = value([(0, 40, 60)])
    assert crossed["value"] == pytest.approx(passed, abs=1e-4)
    if n == 1:
        assert crossed["p"] == 0.5


def test_edges_and_filters(spark):
    kept = preprocess.preprocess(points(spark, (20, -20, 0.3), (1.5, 0, 3.0), (1.49, 0, 1), (3, 0, 3.01), (20.01, 0, 1)), frames(spark))
    assert sorted((r["row"], r["col"]) for r in kept.collect()) == [(40, 43), (79, 79)]


def test_angle_pi_is_bin_0(spark):
    assert metrics.seen_ranges(preprocess.preprocess(points(spark, (-5, 0, 1)), frames(spark))).first()["bin"] == 0


def test_rays_against_steps(spark):
    def steps(r, c):
        out, dr, dc = [(40, 40)], abs(r - 40), abs(c - 40)
        err, y, x = dc - dr, 40, 40
        while (y, x) != (r, c):
            twice = 2 * err
            if twice > -dr:
                err, x = err - dr, x + (1 if c > 40 else -1)
            if twice < dc:
                err, y = err + dc, y + (1 if r > 40 else -1)
            out.append((y, x))
        return out

    ends = [(r, c) for r in range(0, 80, 3) for c in range(0, 80, 3)] + [(40, 40)]
    df = spark.createDataFrame(ends, "r int, c int").withColumn("ray", ray(F.col("r"), F.col("c"), F.lit(40), F.lit(40)))
    for row in df.collect():
        want = steps(row["r"], row["c"])
        assert [(p["row"], p["col"]) for p in row["ray"]] == want
        assert line(row["r"], row["c"], (40, 40)).tolist() == [list(p) for p in want]


def test_nothing_occupied_counts_as_border(spark):
    kept = preprocess.preprocess(points(spark, (10, 0.1, 1)), frames(spark))
    empty = tier1.single_scan_map(kept).filter("value < 0")
    assert metrics.angular_nmse(empty, kept).first()["nmse"] == pytest.approx((10.0005 - 28.4) ** 2 / 10.0005**2, rel=1e-3)


def test_box_scores(spark):
    schema = "dataset string, scene_id string, frame_idx int, box_id int, cx double, cy double, w double, l double, yaw double"
    far = spark.createDataFrame([("d", "s", 0, 1, 30.0, 0.0, 2.0, 4.0, 0.0)], schema)
    m = tier1.single_scan_map(cells(spark, [(0, 40, 50)]))
    score = lambda b, **k: metrics.precision(m, b, boxes.rasterize(b), **k).first()["precision"]
    assert score(far) == 0 and score(far, zero_outside=True) == 0 and score(far.limit(0)) is None
    assert metrics.iobb(m, boxes.rasterize(far)).count() == 0
    near = spark.createDataFrame([("d", "s", 0, 1, 5.25, -0.25, 1.0, 1.0, math.pi / 6), ("d", "s", 0, 2, 5.25, 5.0, 0.1, 0.1, 0.0)], schema)
    assert metrics.iobb(m, boxes.rasterize(near)).first()["n_objects"] == 1 and score(near) == 1


def test_windows_and_scenes(spark):
    pts = points(spark, (5, 1, 1), (7, -3, 2)).union(points(spark, (5, 1, 1), (9, 9, 1), frame=1))
    fr = frames(spark, 2)
    single = {(r["frame_idx"], r["row"], r["col"]): round(r["value"], 9) for r in tier1.single_scan_map(preprocess.preprocess(pts, fr)).collect()}
    fused = tier1.fuse_windows(tier1.window_points(pts, fr, 1), [0, 1])
    assert {(r["frame_idx"], r["row"], r["col"]): round(r["value"], 9) for r in fused.filter("w = 0").collect()} == single
    one = pts.filter("frame_idx = 0")
    kept = preprocess.preprocess(one, frames(spark))
    a = {(r["row"], r["col"]): r["value"] for r in tier1.scene_map(kept).collect()}
    b = {(r["row"], r["col"]): r["value"] for r in tier1.world_map(kept, frames(spark)).collect()}
    assert a == b == {k[1:]: pytest.approx(v) for k, v in single.items() if k[0] == 0}


def test_smoothing_matches_full_stencil(spark):
    grid = Grid(12, 0.5)
    rng = np.random.default_rng(1)
    full = np.full((12, 12), 0.5)
    rows = [(int(r), int(c), float(np.float32(rng.random()))) for r, c in {(rng.integers(12), rng.integers(12)) for _ in range(20)}]
    for r, c, p in rows:
        full[r, c] = p
    w = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    w /= w.sum()
    pad = np.pad(full, 3, mode="symmetric")
    want = sum(w[i] * w[j] * pad[i : i + 12, j : j + 12] for i in range(7) for j in range(7))
    df = spark.createDataFrame([("d", "s", 0, *r) for r in rows], "dataset string, scene_id string, frame_idx int, row int, col int, p double")
    got = np.full((12, 12), 0.5)
    for r in reports.smoothed(df, grid).collect():
        got[r["row"], r["col"]] = r["p"]
    assert np.allclose(got, want)


def dense_solve(hits, h, size, ego, s):
    """The same steps with the full normal matrix."""
    n = size * size
    a0, rhs = np.zeros((n, n)), np.zeros(n)
    for (r, c), k in zip(hits, h, strict=True):
        u = np.zeros(n)
        u[[i * size + j for i, j in line(r, c, ego)]] = s.free_weight
        a0[r * size + c, r * size + c] += k
        a0 += k * np.outer(u, u)
        rhs[r * size + c] += k
    sums = lambda f: sum(np.pad(f.reshape(size, size), 1)[1 + i : size + 1 + i, 1 + j : size + 1 + j] for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))).ravel()
    mu = s.gamma * rhs / (s.gamma * rhs + 1)
    alpha, mu = np.clip((2 * s.shape + 1) / (2 * s.rate + mu**2 + 1 / s.gamma), s.alpha_min, s.alpha_max), np.zeros(n)
    for it in range(1, s.max_iter + 1):
        inv = np.linalg.inv(s.gamma * a0 + np.diag(alpha + s.beta * sums(alpha)))
        new = inv @ (s.gamma * rhs)
        v = new**2 + np.diag(inv)
        up = np.clip((2 * s.shape + 1) / (2 * s.rate + v + s.beta * sums(v)), s.alpha_min, s.alpha_max)
        alpha = up if it == 1 else (1 - s.damping) * alpha + s.damping * up
        change, mu = np.linalg.norm(new - mu) / np.linalg.norm(new), new
        if change < s.tol:
            break
    return mu, it


@pytest.mark.parametrize("s", [Settings(max_iter=20), Settings(beta=0.0, max_iter=20), Settings(free_weight=0.0, max_iter=20)])
def test_solver_matches_dense(s):
    rng = np.random.default_rng(2)
    hits = sorted({(int(r), int(c)) for r, c in rng.integers(0, 16, (25, 2))} - {(8, 8)})
    h = rng.integers(1, 4, len(hits)).astype(float)
    rows, cols = np.array(hits).T
    got = solve(rows, cols, h, h, h, 30, 16, (8, 8), s)
    mu, it = dense_solve(hits, h, 16, (8, 8), s)
    assert np.allclose(got.mu, mu, atol=1e-9) and got.iters == it


def dense_windows(rows, size, ego, s):
    """The same steps with the whole matrix, a row for each entry of ``rows`` (row, col, weight): noise estimated if gamma isn't above 0."""
    n, c, y = size * size, [], []
    for r, col, w in rows:
        for cells, weight, target in (([(r, col)], w, w), (line(r, col, ego), w * s.free_weight, 0.0)):
            c.append(np.zeros(n))
            c[-1][[i * size + j for i, j in cells]] = weight
            y.append(target)
    c, y = np.array(c), np.array(y)
    sums = lambda f: sum(np.pad(f.reshape(size, size), 1)[1 + i : size + 1 + i, 1 + j : size + 1 + j] for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))).ravel()
    gamma, loud = s.gamma if s.gamma > 0 else s.gamma_start, y > 0.5
    start = (c[loud] ** 2).sum(axis=0)
    mu = gamma * start / (gamma * start + 1)
    alpha, mu, found = np.clip((2 * s.shape + 1) / (2 * s.rate + mu**2 + 1 / gamma), s.alpha_min, s.alpha_max), np.zeros(n), []
    for it in range(1, s.max_iter + 1):
        inv = np.linalg.inv(gamma * c.T @ c + np.diag(alpha + s.beta * sums(alpha)))
        new, var = inv @ (gamma * c.T @ y), np.diag(inv)
        v = new**2 + var
        up = np.clip((2 * s.shape + 1) / (2 * s.rate + v + s.beta * sums(v)), s.alpha_min, s.alpha_max)
        alpha = up if it == 1 else (1 - s.damping) * alpha + s.damping * up
        if s.gamma <= 0:
            gamma = np.clip(len(y) / (((y - c @ new) ** 2).sum() + (c != 0).sum(axis=0) @ var), 1e-3, 1e6)
        change, mu = np.linalg.norm(new - mu) / np.linalg.norm(new), new
        found.append(gamma)
        if change < s.tol:
            break
    return mu, alpha, it, found


@pytest.mark.parametrize("s", [Settings(gamma=g, beta=b, free_weight=w, max_iter=m) for g in (0.0, 30.0) for b in (0.0, 1.0) for w in (0.0, 0.5) for m in (8, 60)])
def test_windows_match_dense(s):
    """Hits of unequal weights, several of them in a cell."""
    rng = np.random.default_rng(4)
    rows = [(int(r), int(c), 0.85 ** int(k)) for r, c, k in zip(*rng.integers(0, 16, (2, 60)), rng.integers(0, 6, 60))]
    cells = sorted({r[:2] for r in rows})
    of = lambda f: np.array([f([w for r, c, w in rows if (r, c) == x]) for x in cells], dtype=float)
    h, count, start = of(lambda w: sum(x * x for x in w)), of(len), of(lambda w: sum(x * x for x in w if x > 0.5))
    got = solve(*np.array(cells).T, h, count, start, 60, 16, (8, 8), s)
    mu, alpha, it, _ = dense_windows(rows, 16, (8, 8), s)
    assert got.iters == it and np.allclose(got.mu, mu, atol=1e-8) and np.allclose(got.alpha[got.touched], alpha[got.touched], rtol=1e-6)


def test_windows_are_solved_however_few_points(spark):
    window = cells(spark, [(0, 30, 50), (0, 31, 50)]).withColumns({"offset": F.lit(0), "x": F.lit(5.0), "y": F.col("row") / 10.0})
    assert tier2.window_maps(window).first()["iters"] > 0
    assert tier2.frame_maps(window).first()["iters"] == 0


def test_few_points_and_adaptive_noise():
    one = np.array([3]), np.array([4]), np.ones(1), np.ones(1), np.ones(1)
    got = solve(*one, 4, 16, (8, 8), Settings())
    assert (got.iters, got.converged, got.cells()) == (0, False, [])
    assert solve(*one, 9, 16, (8, 8), Settings(gamma=0.0, max_iter=5)).iters > 0


def test_one_sector_and_one_tile_equal_the_plain_map(spark):
    rng = np.random.default_rng(3)
    kept = preprocess.preprocess(points(spark, *(np.c_[rng.uniform(-8, 8, (60, 2)), np.ones(60)])), frames(spark))
    s = Settings(max_iter=8)
    key = lambda df: {(r["row"], r["col"]): round(r["p"], 6) for r in df.collect()}
    plain = key(tier2.solved_cells(tier2.frame_maps(kept, s)))
    assert key(tier2.sector_maps(kept, 1, s)) == plain == key(tier2.tile_maps(kept, 1, s))
    window = kept.withColumn("offset", F.lit(0))
    assert key(tier2.solved_cells(tier2.window_maps(window, settings=s))) == plain
    swept = tier2.swept_maps(kept, s, beta=[0.0, 1.0])
    assert key(tier2.solved_cells(swept.filter("beta = 1.0"), [*FRAME, "beta"])) == plain
    assert tier2.sector_maps(kept, 4, s).count() > 0


def test_folding_in_ranges_of_frames(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("d", "s", f, 3, c, int(rng.integers(0, 9)), int(rng.integers(0, 2))) for f in range(40) for c in range(6) if rng.random() < 0.8]
    found = spark.createDataFrame(rows, "dataset string, scene_id string, frame_idx int, row int, col int, n_hits long, is_free int")
    want = {}
    for *_, c, n, free in rows:
        want[c] = max(-5.0, min(5.0, want.get(c, 0.0) + n * EVIDENCE) - free * EVIDENCE)
    for size in (3, 512):
        monkeypatch.setattr(tier1, "FOLD", size)
        got = {r["col"]: (r["value"], r["n_scans"]) for r in tier1.folded(found, ["dataset", "scene_id"]).collect()}
        assert got == {c: (pytest.approx(v), sum(r[4] == c for r in rows)) for c, v in want.items()}


def test_far_frames_of_a_window_do_not_count_at_the_start(spark):
    window = spark.createDataFrame([("d", "s", 0, o, r, 50, float(r), float(o)) for o, r in [(0, 30), (0, 31), (0, 32), (2, 33), (2, 34), (2, 35)]], "dataset string, scene_id string, frame_idx int, offset int, row int, col int, x double, y double")
    s = Settings(max_iter=1, beta=0.0, free_weight=0.0)
    alpha = {r["row"]: r["alpha"] for r in tier2.solved_cells(tier2.window_maps(window, decay=0.7, settings=s)).filter("col = 50").collect()}
    mu = {r["row"]: r["mu"] for r in tier2.solved_cells(tier2.window_maps(window, decay=0.7, settings=s)).filter("col = 50").collect()}
    g, start = s.gamma, lambda h: (2e-4 + 1) / (2e-4 + (s.gamma * h / (s.gamma * h + 1)) ** 2 + 1 / s.gamma)
    assert mu[30] == pytest.approx(g / (start(1) + g)) and alpha[30] > 0
    h = 0.7**4
    assert mu[33] == pytest.approx(g * h / (start(0) + g * h))


def test_points_are_cut_to_hits_before_they_are_shuffled(spark, tmp_path):
    # frames of a known, small size: else their join deals out the points by frame, and no shuffle follows
    frames(spark).write.parquet(str(tmp_path / "frames"))
    kept = preprocess.preprocess(points(spark, (5, 1, 1), (7, -3, 2)), spark.read.parquet(str(tmp_path / "frames")))
    plan = tier2.frame_maps(kept)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it


def test_live_map_equals_stored(spark, tmp_path):
    found = tier1.evidence(cells(spark, [(f, 40, 45 + (f * i) % 3) for f in range(5) for i in range(4)]))
    found.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = live_scene_map(spark.readStream.schema(found.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["row"], r["col"]): (round(r["value"], 9), r["n_scans"]) for r in spark.table("live").collect()}
    want = {(r["row"], r["col"]): (round(r["value"], 9), r["n_scans"]) for r in tier1.folded(found, ["dataset", "scene_id"]).collect()}
    assert got == want


def test_live_map_with_late_scans_equals_stored(spark, tmp_path):
    """Scans in any order over several batches, some split between batches; those too far behind are left out."""
    rng = np.random.default_rng(12)
    schema = "dataset string, scene_id string, frame_idx int, row int, col int, n_hits long, is_free int"
    order = sorted(range(40), key=lambda f: f + rng.integers(0, 8))
    batches, late = [order[i : i + 8] for i in range(0, 40, 8)], 12
    rows = {f: [("d", s, f, int(r), int(c), int(n), int(b)) for s in "ab" for r, c, n, b in zip(*rng.integers(0, 4, (2, 5)), rng.integers(0, 9, 5), rng.integers(0, 2, 5))] for f in range(40)}
    rows = {f: list({r[:5]: r for r in of}.values()) for f, of in rows.items()}
    sent = [[r for f in b for r in rows[f]] for b in batches]
    sent[2].append(sent[1].pop())  # a row of a scan that comes after the others
    sent[4].append(("d", "a", 1, 0, 0, 5, 0))  # far behind
    (tmp_path / "in").mkdir()
    stream = live_scene_map(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late)
    q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / f"out/batch={i}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i, part in enumerate(sent):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        for f in (tmp_path / f"made{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
        q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        got[r["scene_id"], r["row"], r["col"]] = (round(r["value"], 9), r["n_scans"])
    every = spark.createDataFrame([r for of in rows.values() for r in of], schema)
    want = {(r["scene_id"], r["row"], r["col"]): (round(r["value"], 9), r["n_scans"]) for r in tier1.folded(every, ["dataset", "scene_id"]).collect()}
    assert got == want


def test_camera_frames(spark):
    tr = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 0.1, 0, 0, -1, 0.2, 1, 0, 0, 0.3)))
    r, t = g.camera_calibration(tr)
    got = spark.range(1).select(r.alias("r"), t.alias("t")).first()
    assert got["r"] == [0, -1, 0, 1, 0, 0, 0, 0, 1] and got["t"] == pytest.approx([0.1, 0.3, -0.2])


def test_solver_queries_run_to_the_default_limit(spark):
    from fleetgrid.plans.queries import QUERIES

    rows = QUERIES["w4_trace"](spark, "/root/testdata/sf0.001").groupBy("beta").agg({"iteration": "max"}).collect()
    most = {r["beta"]: r["max(iteration)"] for r in rows}
    assert most.keys() == {0.0, 1.0} and 40 < max(most.values()) <= 150


def test_box_rows_match_a_look_at_every_cell(spark):
    """Boxes at right angles and at others, thin ones between cells, and over the map's edges."""
    rng = np.random.default_rng(8)
    rows = [(float(x), float(y), float(w), float(h), float(a)) for x, y, w, h, a in zip(*rng.uniform(-22, 22, (2, 300)), rng.uniform(0.05, 6, 300), rng.uniform(0.05, 9, 300), rng.choice([0.0, math.pi / 2, math.pi, 0.3, 1.2, -2.5, 3.0], 300))]
    rows += [(0.25, 0.25, 0.5, 0.5, 0.0), (0.0, 0.0, 1.0, 1.0, 0.0), (19.9, 19.9, 4.0, 4.0, 0.7), (-21.0, 0.0, 1.0, 1.0, 0.0), (30.0, 0.0, 2.0, 4.0, 0.0)]
    schema = "dataset string, scene_id string, frame_idx int, box_id int, cx double, cy double, w double, l double, yaw double"
    df = spark.createDataFrame([("d", "s", 0, i, *r) for i, r in enumerate(rows)], schema)
    for grid in (Grid(), Grid(130, 0.3)):
        row, col = np.mgrid[: grid.size, : grid.size]
        want = set()
        for i, (x, y, w, length, a) in enumerate(rows):
            dx, dy = (col + 0.5) * grid.cell - grid.half - x, grid.half - (row + 0.5) * grid.cell - y
            c, s = math.cos(a), math.sin(a)
            want |= {(i, int(p), int(q)) for p, q in zip(*np.nonzero((abs(dx * c + dy * s) < length / 2) & (abs(dy * c - dx * s) < w / 2)))}
        assert {(r["box_id"], r["row"], r["col"]) for r in boxes.rasterize(df, grid).collect()} == want
        n = boxes.words_of_row(grid)
        bits = {(r["box_id"], w["word"] // n, 64 * (w["word"] % n) + b) for r in boxes.masks(df, grid).collect() for w in r["words"] for b in range(64) if w["mask"] >> b & 1}
        assert bits == want


def test_scores_in_one_row_match_the_single_scores(spark):
    rng = np.random.default_rng(9)
    kept = preprocess.preprocess(points(spark, *np.c_[rng.uniform(-15, 15, (400, 2)), np.ones(400)]).union(points(spark, (5, 5, 1), frame=1)), frames(spark, 3))
    schema = "dataset string, scene_id string, frame_idx int, box_id int, cx double, cy double, w double, l double, yaw double"
    near = spark.createDataFrame([("d", "s", 0, i, *map(float, r)) for i, r in enumerate(np.c_[rng.uniform(-18, 18, (12, 2)), rng.uniform(1, 5, (12, 2)), rng.uniform(-3, 3, 12)])] + [("d", "s", 0, 99, 50.0, 0.0, 1.0, 1.0, 0.0)], schema)
    for grid in (Grid(), Grid(130, 0.3)):
        m = tier1.single_scan_map(preprocess.discretize(kept.drop("row", "col"), grid), grid)
        got = {r["frame_idx"]: r for r in metrics.scores(m, kept, near, grid).collect()}
        cells_ = boxes.rasterize(near, grid)
        single = [metrics.angular_nmse(m, kept, grid), metrics.iobb(m, cells_), metrics.precision(m, near, cells_)]
        for name, of in (("nmse", 0), ("iobb", 1), ("n_objects", 1), ("n_occupied", 2), ("precision", 2)):
            want = {r["frame_idx"]: r[name] for r in single[of].collect()}
            assert {f: r[name] for f, r in got.items()} == {f: want.get(f) if want.get(f) is None else pytest.approx(want[f]) for f in got}, name


def test_scores_make_the_map_once(spark, tmp_path):
    frames(spark, 2).write.parquet(str(tmp_path / "frames"))
    points(spark, (5, 1, 1), (7, -3, 2)).write.parquet(str(tmp_path / "points"))
    kept = preprocess.preprocess(spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "frames")))
    near = spark.createDataFrame([("d", "s", 0, 1, 5.0, 0.0, 2.0, 4.0, 0.0)], "dataset string, scene_id string, frame_idx int, box_id int, cx double, cy double, w double, l double, yaw double")
    plan = metrics.scores(tier1.single_scan_map(kept), kept, near)._jdf.queryExecution().executedPlan().toString()
    assert rays_and_what_follows(plan) == [[]]


def rays_and_what_follows(plan):
    """For each place where rays are made, the shuffles between it and the result."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Generate explode(transform(sequence(0, greatest(abs" in line:
            own, over = depth(line), []
            for x in reversed(lines[:i]):
                if depth(x) < own:
                    own = depth(x)
                    if "collect_list(struct(word" in x:  # packed: a row a frame
                        break
                    over += [x] * ("Exchange" in x)
            out.append(over)
    return out


def test_windows_by_spans(spark, tmp_path):
    """Windows over the edges of spans and over missing frames; a point is shuffled once for each span that needs it."""
    rng = np.random.default_rng(7)
    number = [f for f in range(-5, 90) if f not in (3, 31, 32, 40)]
    turn = lambda a: [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]
    preprocess.with_defaults(spark.createDataFrame([("d", s, f, None, [0.0] * 3, turn(0.02 * f), [0.3 * f, 0.1 * f, 0.0]) for s in "ab" for f in number], FRAMES)).write.parquet(str(tmp_path / "frames"))
    rows = [("d", s, int(f), *map(float, p)) for s in "ab" for f in rng.choice(number, 300) for p in [rng.uniform((-25, -25, 0), (25, 25, 4))]]
    spark.createDataFrame(rows, POINTS).write.parquet(str(tmp_path / "points"))
    fr, pts = (spark.read.parquet(str(tmp_path / n)) for n in ("frames", "points"))
    seen = preprocess.height_filter(preprocess.transform_to_ego(pts, fr)).collect()
    pose = {(r["scene_id"], r["frame_idx"]): (np.array(r["pose_r"]).reshape(3, 3), np.array(r["pose_t"])) for r in fr.collect()}
    for w in (0, 2):
        want = []
        for r in seen:
            for k in range(r["frame_idx"] - w, r["frame_idx"] + w + 1):
                if (r["scene_id"], k) in pose:
                    (rj, tj), (rk, tk) = pose[r["scene_id"], r["frame_idx"]], pose[r["scene_id"], k]
                    x, y, _ = rk.T @ (rj @ [r["x"], r["y"], r["z"]] + tj - tk)
                    if abs(x) <= 20 and abs(y) <= 20 and math.hypot(x, y) >= 1.5:
                        want.append((r["scene_id"], k, r["frame_idx"] - k, x, y))
        window = tier1.window_points(pts, fr, w)
        got = sorted((r["scene_id"], r["frame_idx"], r["offset"], r["x"], r["y"]) for r in window.collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3:] for r in got], [r[3:] for r in sorted(want)], atol=1e-4)
    plan = tier1.fuse_windows(window, [0, 2])._jdf.queryExecution().executedPlan().toString()
    assert rays_and_what_follows(plan) == [[]]
    # the points that are dealt out, before they fan out
    copies = tier1.spanned(preprocess.height_filter(preprocess.transform_to_ego(pts, fr)), 2).count()
    assert len(seen) < copies <= len(seen) * (1 + 2 * 2 / tier1.SPAN) * 1.05


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quartiles_against_all_scores(spark, accuracy):
    rng = np.random.default_rng(11)
    made = {f"n{n}": rng.normal(size=n) for n in (1, 2, 3, 4, 5, 7, 10, 101, 4000)} | {"ties": rng.integers(0, 3, 3000).astype(float), "one": np.full(500, 2.5), "skew": rng.pareto(0.5, 2500)}
    rows = [(m, float(v)) for m, vs in made.items() for v in vs] + [("n5", None), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "method string, nmse double").repartition(6)
    got = {r["method"]: r for r in reports.distribution(df, accuracy=accuracy).collect()}
    made[None] = np.array([1.0, 3.0])
    for m, vs in made.items():
        assert [got[m][c] for c in reports.QUARTILES] == pytest.approx(np.quantile(vs, [0, 0.25, 0.5, 0.75, 1]).tolist()) and got[m]["n"] == len(vs), m
    assert got["none"]["n"] == 0 and got["none"]["median"] is None and len(got) == len(made) + 1
    for r in reports.summary(df, accuracy=accuracy).collect():
        vs = np.sort(made[r["method"]])
        for c, q in reports.QUARTILES.items():
            low, high = np.searchsorted(vs, r[c]), np.searchsorted(vs, r[c], "right")
            assert low - 1 <= q * len(vs) + len(vs) / accuracy and high + 1 >= q * len(vs) - len(vs) / accuracy


def test_rays_of_scans_with_other_egos(spark):
    """Cells that rays touch, for scans with an ego cell of their own, against the array form of a ray."""
    rng = np.random.default_rng(10)
    rows = [("d", "s", f, int(r), int(c), 5 + f, 30 - f) for f in range(9) for r, c in rng.integers(0, 40, (12, 2))] + [("d", "s", 0, 5, 30, 5, 30)] * 3
    df = spark.createDataFrame(rows, "dataset string, scene_id string, frame_idx int, row int, col int, er int, ec int")
    line = F.explode(ray(F.col("row"), F.col("col"), F.col("er"), F.col("ec"))).alias("c")
    end = F.col("c.i") == F.col("c.m")
    want = df.select(*FRAME, line).groupBy(*FRAME, "c.row", "c.col").agg(F.sum(end.cast("long")).alias("n_hits"), F.max((~end).cast("int")).alias("is_free"))
    got = tier1.evidence(df, grid=Grid(40, 1.0), ego=(F.col("er"), F.col("ec")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_map_tasks_are_not_joined_by_size(spark):
    """A scan's hits are few bytes that grow to a map, so their tasks stay as many as the session shuffles into."""
    found = tier1.evidence(cells(spark, [(f, 40, 45) for f in range(50)]))
    assert found.rdd.getNumPartitions() >= tier1.parts(spark)


def test_boxes_meet_packed_maps(spark):
    """Scores from boxes, without their cells, are those from cells; frames without a map or a box keep their places."""
    rng = np.random.default_rng(11)
    kept = preprocess.preprocess(points(spark, *np.c_[rng.uniform(-15, 15, (300, 2)), np.ones(300)]).union(points(spark, (5, 5, 1), frame=1)), frames(spark, 3))
    m = tier1.single_scan_map(kept)
    schema = "dataset string, scene_id string, frame_idx int, box_id int, cx double, cy double, w double, l double, yaw double"
    rows = [("d", "s", i % 2 * 2, i, *map(float, r)) for i, r in enumerate(np.c_[rng.uniform(-18, 18, (12, 2)), rng.uniform(1, 5, (12, 2)), rng.uniform(-3, 3, 12)])]
    near = spark.createDataFrame([*rows, ("d", "s", 1, 99, 50.0, 0.0, 1.0, 1.0, 0.0)], schema)
    cells_ = boxes.rasterize(near)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)
    counts = metrics.box_counts(m, near)
    assert same(metrics.box_hits(m, cells_), counts) and same(metrics.overlay(m, near, cells_), metrics.overlaid(near, counts))
    for zero in (False, True):
        assert same(metrics.precision(m, near, cells_, zero_outside=zero), metrics.box_precision(m, near, near, zero_outside=zero))
    plan = metrics.box_precision(m, near, near)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(first" not in plan


def test_inverse_by_halves():
    rng = np.random.default_rng(12)
    for n in (1, 64, 65, 200):
        a = rng.normal(size=(n, n))
        a = a @ a.T + n * np.eye(n)
        assert np.allclose(inverse_of(a) @ a, np.eye(n), atol=1e-9)


def test_solves_come_in_batches(spark):
    """Many keys in one task, more than are sent at once, with one that has too few points and one that fails; no key is a pandas group."""
    rows = [(f, 40 + i, 41 + f) for f in range(40) for i in range(6)]
    kept = cells(spark, rows).withColumn("n_points", F.when(F.col("frame_idx") == 3, 2).otherwise(6)).withColumn("gamma", F.when(F.col("frame_idx") == 5, float("nan")).otherwise(30.0)).coalesce(1)
    out = tier2.pcsbl_map(kept, settings=Settings(max_iter=3))
    got = {r["frame_idx"]: r for r in out.collect()}
    assert len(got) == 40 and got[3]["cells"] == [] and got[3]["iters"] == 0
    for f in (0, 17, 39):
        n = np.ones(6)
        want = solve(np.arange(40, 46), np.full(6, 41 + f), n, n, n, 6, 80, (40, 40), Settings(max_iter=3)).cells()
        assert [(c["row"], c["col"]) for c in got[f]["cells"]] == [(c["row"], c["col"]) for c in want]
        assert np.allclose([c["mu"] for c in got[f]["cells"]], [c["mu"] for c in want])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_smoothing_and_differences_send_no_copies(spark):
    """Maps of many scans, more than are laid out at once, are smoothed without a shuffle after their own; differences need no sorted join."""
    rows = [(f, (7 * f) % 80, (3 * f + i) % 80) for f in range(70) for i in (0, 40)]
    m = cells(spark, rows).withColumn("p", F.lit(0.9).cast("float"))
    got = reports.smoothed(m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert got.select(*FRAME).distinct().count() == 70 and got.groupBy(*FRAME).agg(F.sum(F.col("p") - 0.5).alias("s")).filter("abs(s - 0.8) > 1e-6").count() == 0
    other = m.filter("frame_idx < 5").withColumn("p", F.lit(0.25).cast("float"))
    diff = reports.difference(m, other)
    assert sorted({(r["frame_idx"] < 5, round(r["diff"], 6)) for r in diff.collect()}) == [(False, 0.4), (True, 0.65)] and diff.count() == 140
    assert "SortMergeJoin" not in diff._jdf.queryExecution().executedPlan().toString()


def test_drawn_rays_equal_merged_rows(spark):
    """More scans than are laid out, and more rays than are drawn, at a time; hits on the vehicle, repeated hits, several ego cells in a scan."""
    rng = np.random.default_rng(13)
    rows = [("d", f"s{f % 3}", f, int(r), int(c), 40 - f % 5, 40 + f % 3 + int(r) % 2 * (f % 7 == 0)) for f in range(70) for r, c in rng.integers(0, 80, (rng.integers(1, 40), 2))]
    rows += [("d", "s", 99, int(r), int(c), 40, 40) for r, c in [*rng.integers(0, 80, (3000, 2)), (40, 40), (40, 40)]]
    rows += [("d", "s", 100, 40, 40, 40, 40)]
    df = spark.createDataFrame(rows, "dataset string, scene_id string, frame_idx int, row int, col int, er int, ec int").repartition(3)
    for ego in (None, (F.col("er"), F.col("ec"))):
        want, got = (tier1.evidence(df, ego=ego, merged=m) for m in (False, True))
        assert want.dtypes == got.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("fill", [0.5, 0.0, 0.7])
def test_concentration_against_whole_maps(spark, fill):
    """Maps of few and of many values, on few and on most cells, with values equal to that of untouched cells."""
    rng, grid = np.random.default_rng(14), Grid(20, 2.0)
    made = {f: rng.choice([0.1, 0.5, fill, 0.7, 0.9], n) if f % 2 else rng.random(n) for f, n in enumerate((1, 3, 39, 41, 200, 350, 361, 400, 400))}
    rows = [("d", "s", f, i // 20, i % 20, float(p)) for f, ps in made.items() for i, p in zip(rng.permutation(400).tolist(), ps, strict=False)]
    m = spark.createDataFrame(rows, "dataset string, scene_id string, frame_idx int, row int, col int, p double").repartition(3)
    got = {r["frame_idx"]: r for r in reports.concentration(m, grid, fill).collect()}
    assert got.keys() == made.keys()
    for f, ps in made.items():
        whole, r = np.r_[ps, np.full(400 - len(ps), fill)], got[f]
        q = np.quantile(whole, 0.9)
        top = whole[whole > q + 1e-12]
        assert r["p90"] == pytest.approx(q) and r["mean_p"] == pytest.approx(whole.mean()) and r["n_occupied"] == (ps > 0.5).sum()
        assert r["mean_top"] == pytest.approx(top.mean()) if len(top) else r["mean_top"] is None


def test_concentration_holds_no_lists_of_cells(spark):
    """Neither the cells of all rays in one table, nor a map's values one by one: a list has a map's distinct values."""
    from fleetgrid.plans.queries import QUERIES

    out = QUERIES["a21_concentration"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(transform(sequence(0, greatest(abs" not in plan and "collect_list(cast(p" not in plan
    m = cells(spark, [(f, r, c) for f in range(2) for r in range(60) for c in range(60)]).withColumn("p", F.lit(0.9).cast("float"))
    counted = reports.concentration(m)
    assert "collect_list(cast(p" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [(round(r["p90"], 6), r["mean_top"], r["n_occupied"]) for r in counted.collect()] == [(0.9, None, 3600)] * 2


@pytest.mark.parametrize("s", [Settings(), Settings(beta=0.0), Settings(beta=0.5, max_iter=7), Settings(gamma=0.0), Settings(gamma=0.0, beta=0.0, free_weight=0.8), Settings(free_weight=0.0, max_iter=5)])
def test_maps_are_solved_together(s):
    """Maps of few and of many rays, around other ego cells, with rays in several blocks: each as by the whole matrix of its rows."""
    rng = np.random.default_rng(15)
    made, egos = [], [(8, 8), (8, 8), (0, 15), (3, 9), (8, 8), (15, 15)]
    for n in (1, 40, 60, 250, 250, 5):
        rows = [(int(r), int(c), 0.85 ** int(k)) for r, c, k in zip(*rng.integers(0, 16, (2, n)), rng.integers(0, 6, n))]
        cells = sorted({r[:2] for r in rows})
        of = lambda f: np.array([f([w for r, c, w in rows if (r, c) == x]) for x in cells], dtype=float)  # noqa: E731, B023
        made.append((rows, (*np.array(cells).T, of(lambda w: sum(x * x for x in w)), of(len), of(lambda w: sum(x * x for x in w if x > 0.5)))))
    found = solve_all([hits for _, hits in made], [len(rows) for rows, _ in made], 16, egos, s)
    assert (found[0].iters, found[0].cells()) == (0, [])
    for (rows, _), ego, got in list(zip(made, egos, found, strict=True))[1:]:
        mu, alpha, it, _ = dense_windows(rows, 16, ego, s)
        assert got.iters == it and np.allclose(got.mu, mu, atol=1e-8) and np.allclose(got.alpha[got.touched], alpha[got.touched], rtol=1e-6)


def test_rays_are_inverted_by_blocks():
    """What is held and inverted for a window's rays is a small part of the matrix of all their pairs, also for many rays."""
    rng = np.random.default_rng(16)
    for n in (800, 1600, 6400):
        cells = np.unique(rng.integers(0, 160, (n, 2)), axis=0).astype(np.int64)
        one = np.ones(len(cells))
        lay = Layout(np.zeros(len(cells), dtype=np.int64), *cells.T, one, one, one, np.array([[80, 80]]), 160, True)
        assert len(np.unique(lay.slot)) == len(cells) and len(lay.near) == lay.p < 100
        assert 2 * lay.m * lay.b**2 + lay.m * lay.b * lay.p < len(cells) ** 2 / 5


@pytest.mark.parametrize("windows", [[0, 1, 2], [2], [3, 0]])
def test_fused_windows_drawn_into_maps(spark, windows):
    """More frames than are laid out at a time, frames that see one neighbour only, cells hit often, hits on the vehicle; no cell of a ray is a row."""
    rng = np.random.default_rng(17)
    rows = [("d", f"s{f % 2}", f, f // 16, int(o), int(r), int(c)) for f in range(40) for o in ((-2, -1, 0, 1, 3) if f % 5 else (-1,)) for r, c in rng.integers(0, 80, (rng.integers(1, 12), 2)) for _ in range(rng.integers(1, 9))]
    rows += [("d", "s9", 0, 0, 0, 40, 40)] * 7
    window = spark.createDataFrame(rows, "dataset string, scene_id string, frame_idx int, span int, offset int, row int, col int").repartition(3)
    want, got = (tier1.fuse_windows(window, windows, merged=m) for m in (False, True))
    assert want.dtypes == got.dtypes
    of = lambda df: {tuple(r[c] for c in (*FRAME, "row", "col", "w")): (r["value"], r["p"]) for r in df.collect()}
    want, made = of(want), of(got)
    assert want.keys() == made.keys() and all(made[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()) and got.count() == len(made)
    assert "Generate explode(transform(sequence(0, greatest(abs" not in got._jdf.queryExecution().executedPlan().toString()


def test_fusion_query_draws_rays_into_maps(spark):
    from fleetgrid.plans.queries import QUERIES

    plan = QUERIES["a6_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(transform(sequence(0, greatest(abs" not in plan


def test_sectors_are_merged_without_shuffling_cells(spark):
    """A frame's sectors are merged by the largest value of a cell, from a row for each; frames with too few points in a sector, or in all, keep the others."""
    rng = np.random.default_rng(18)
    near = [(f, int(r), int(c)) for f in range(20) for r, c in rng.integers(20, 60, (4 if f == 3 else 30, 2))]
    kept = cells(spark, near).withColumns({"x": (F.col("col") - 40) / 2 + 0.25, "y": (40 - F.col("row")) / 2 - 0.25})
    got = tier2.sector_maps(kept, 3, Settings(max_iter=4))
    dealt = kept.withColumn("sector", g.sector(F.col("x"), F.col("y"), 3))
    solved = tier2.pcsbl_map(tier2.counted_hits(dealt, [*FRAME, "sector"], 3, 360, least=3), [*FRAME, "sector"], Settings(max_iter=4))
    want = tier2.solved_cells(solved, [*FRAME, "sector"]).groupBy(*FRAME, "row", "col").agg(F.max("p").alias("p"))
    assert want.dtypes == got.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("frame_idx").distinct().count() >= 19
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "functions=[max(p" not in plan and "inline(pythonUDF" in plan
