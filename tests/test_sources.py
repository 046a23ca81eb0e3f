import os
import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgrid.functions import geometry as g
from fleetgrid.operators import catalog
from fleetgrid.sources import readers


def test_metadata_and_keyframes(spark, tmp_path):
    tables = {
        "scene": [{"token": "s1", "name": "scene-1", "description": "d", "nbr_samples": 2, "first_sample_token": "m1"}],
        "sample": [{"token": "m2", "next": "", "scene_token": "s1", "timestamp": 20}, {"token": "m1", "next": "m2", "scene_token": "s1", "timestamp": 10}],
        "sample_data": [
            {"token": f"d{i}{k}", "sample_token": f"m{i}", "filename": f"samples/{k}/{i}", "is_key_frame": True, "ego_pose_token": "p", "calibrated_sensor_token": "c"}
            for i in (1, 2) for k in ("LIDAR_TOP", "CAM_FRONT")
        ],
        "ego_pose": [{"token": "p", "translation": [1, 2, 0], "rotation": [1, 0, 0, 0]}],
        "calibrated_sensor": [{"token": "c", "translation": [0, 0, 1.8], "rotation": [math.sqrt(0.5), 0, 0, math.sqrt(0.5)]}],
        "sample_annotation": [{"token": "a", "sample_token": "m2", "translation": [0, 0, 0], "size": [1, 2, 3], "rotation": [1, 0, 0, 0]}],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=1))
    t = readers.read_metadata(spark, str(tmp_path))
    keys = catalog.keyframes(t["sample"], t["sample_data"])
    assert [(r["frame_idx"], r["sample_token"]) for r in keys.orderBy("frame_idx").collect()] == [(0, "m1"), (1, "m2")]
    assert [r["sample_token"] for r in catalog.linked_order(t["scene"], t["sample"]).orderBy("place").collect()] == ["m1", "m2"]
    frame = catalog.with_lookups(keys, t["ego_pose"], t["calibrated_sensor"]).first()
    assert np.allclose(np.reshape(frame["calib_r"], (3, 3)), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert catalog.annotations_of(keys, t["sample_annotation"]).count() == 1
    with pytest.raises(ValueError):
        catalog.scene_by_name(t["scene"], "other")


def test_points(spark, tmp_path):
    five, four = np.arange(15, dtype="<f4").reshape(3, 5), np.arange(8, dtype="<f4").reshape(2, 4)
    (tmp_path / "a.pcd.bin").write_bytes(five.tobytes())
    (tmp_path / "b.bin").write_bytes(four.tobytes())
    got = readers.read_points(spark, str(tmp_path / "a.pcd.bin"), 5).orderBy("point_idx").collect()
    assert [[r[c] for c in ("x", "y", "z", "intensity", "ring")] for r in got] == five.tolist()
    got = readers.read_points(spark, str(tmp_path / "b.bin"), 4).orderBy("point_idx").collect()
    assert [(r["x"], r["ring"]) for r in got] == [(0.0, None), (4.0, None)]


def test_calibration(spark, tmp_path):
    twelve = " ".join(map(str, range(12)))
    (tmp_path / "a.txt").write_text(f"P0: {twelve}\nno colon here\n\nTr_velo_to_cam: {twelve}\n")
    (tmp_path / "b.txt").write_text("R0_rect: 1 0 0 0 1 0 0 0 1\n")
    calib = readers.read_calib(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    by = {r["path"][-5:]: r["m"] for r in calib.collect()}
    assert set(by["a.txt"]) == {"P0", "Tr_velo_to_cam"} and len(by["b.txt"]["R0_rect"]) == 9
    assert readers.with_sensor_matrix(calib.filter("path like '%a.txt'")).first()["tr"] == [float(i) for i in range(12)]
    with pytest.raises(Exception, match="no sensor-to-camera"):
        readers.with_sensor_matrix(calib).collect()


def test_labels(spark, tmp_path):
    fields = "0 0 0 1 2 3 4 1.5 1.6 4.0 1 1.7 10 0.1"
    (tmp_path / "l.txt").write_text(f"Car {fields}\nDontCare {fields}\nMisc {fields}\nVan 0 0 0 1 2 3 4 1.5 1.6 4.0 1 1.7 10\nCar 0 0 0 1 2 3 4 x 1.6 4.0 1 1.7 10 0\n")
    path = str(tmp_path / "l.txt")
    assert [r["class"] for r in readers.read_labels(spark, path).orderBy("box_id").collect()] == ["Car", "Car"]
    loose = readers.read_labels(spark, path, strict=False).orderBy("box_id").collect()
    assert [r["class"] for r in loose] == ["Car", "Misc"] and loose[0]["l"] == 4.0 and loose[0]["rotation_y"] == 0.1


def test_poses_skip_blank_lines(spark, tmp_path):
    row = lambda v: " ".join([str(v)] * 12)
    (tmp_path / "00.txt").write_text(f"{row(1)}\n\n1 2 3\n{row(2)}\n{row('x')}\n{row(3)}\n")
    got = readers.read_poses(spark, str(tmp_path / "00.txt")).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["p"][0]) for r in got] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_results_log_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "a", "s", 0, 0.5), (datetime(2024, 1, 2), "a", "s", 1, None)], "run_ts timestamp, dataset string, scene_id string, frame_idx int, nmse double")
    path = str(tmp_path / "log")
    readers.append_results(rows, path)
    readers.append_results(rows, path)
    assert readers.read_results(spark, path).count() == 4
    newest = readers.latest(rows.withColumn("kind", F.lit("k"))).collect()
    assert [r["frame_idx"] for r in newest] == [1]
    readers.write_report(rows, str(tmp_path / "report"))
    readers.write_report(rows.limit(1), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 1


def test_scans_in_ranges_of_bytes(spark, tmp_path):
    from fleetgrid.sources.scans import ScanSource

    spark.dataSource.register(ScanSource)
    rng = np.random.default_rng(2)
    sizes = {"a/large.bin": 5000, "a/small.bin": 3, "b/small.bin": 40, "b/empty.bin": 0, "b/_hidden": 7}
    made = {n: rng.normal(size=(k, 5)).astype("<f4") for n, k in sizes.items()}
    for n, data in made.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(data.tobytes())
    read = lambda path, **o: spark.read.format("scans").options(**o).load(str(path))
    got = read(tmp_path, columns=5, split=20_010)
    assert got.rdd.getNumPartitions() == 6  # five pieces of the large file; what is left of it shares a task with the small ones
    rows = {}
    for r in got.collect():
        rows.setdefault(os.path.relpath(r["path"], tmp_path), {})[r["point_idx"]] = [r[c] for c in ("x", "y", "z", "intensity", "ring")]
    assert rows == {n: {i: p for i, p in enumerate(made[n].tolist())} for n in ("a/large.bin", "a/small.bin", "b/small.bin")}
    whole = lambda df: sorted(map(tuple, df.select("point_idx", "x", "y", "z", "intensity", "ring").collect()))
    one = tmp_path / "a/large.bin"
    assert whole(read(one, columns=5)) == whole(readers.read_points(spark, str(one), 5))
    assert read(tmp_path / "b/small.bin", columns=4).filter("ring is not null").isEmpty()
    with pytest.raises(Exception, match="records of 4 numbers"):
        read(tmp_path / "a/small.bin", columns=4).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        read(tmp_path / "c", columns=4).collect()


def test_a_run_is_logged_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "s", i, 0.5) for i in range(6)] + [("b", "s", 0, None)], "dataset string, scene_id string, frame_idx int, nmse double").repartition(3)
    path = str(tmp_path / "log")
    commit = readers._commit

    def dies(*_):
        raise RuntimeError("the driver died")

    monkeypatch.setattr(readers, "_commit", dies)
    with pytest.raises(RuntimeError):
        readers.append_results(rows, path, "run 1/1")
    monkeypatch.setattr(readers, "_commit", commit)
    assert readers.append_results(rows, path, "run 1/2") and readers.read_results(spark, path).count() == 7  # nothing of the run that died
    assert readers.append_results(rows, path, "run 1/1") and not readers.append_results(rows, path, "run 1/1")
    assert readers.read_results(spark, path).groupBy("dataset").count().orderBy("dataset").collect() == [("a", 12), ("b", 2)]
    # two attempts at once: both have written their rows when the first commits
    monkeypatch.setattr(readers, "_commit", lambda *a: (commit(*a), commit(*a))[1])
    assert not readers.append_results(rows, path, "run 2") and readers.read_results(spark, path).count() == 21
    with pytest.raises(Exception, match="CAST|cast"):
        readers.append_results(rows.withColumn("nmse", F.expr("if(frame_idx = 5, cast('x' AS double), nmse)")), path, "run 3")
    assert readers.read_results(spark, path).count() == 21


def test_long_links_in_few_rounds(spark):
    n = 120_000
    order = (spark.range(n).withColumn("token", F.concat(F.lit("m"), (F.col("id") * 7919 % n).cast("string"))).withColumn("next", F.when(F.col("id") < n - 1, F.concat(F.lit("m"), ((F.col("id") + 1) * 7919 % n).cast("string"))).otherwise("")))
    more = spark.createDataFrame([("a0", "a1"), ("a1", "gone"), ("c0", "")], "token string, next string")
    scenes = spark.createDataFrame([("long", "m0"), ("short", "a0"), ("one", "c0"), ("none", "")], "token string, first_sample_token string")
    got = catalog.linked_order(scenes, order.select("token", "next").unionByName(more))
    ends = {r["scene_token"]: (r["n"], r["last"]) for r in got.groupBy("scene_token").agg(F.count("*").alias("n"), F.max_by("sample_token", "place").alias("last")).collect()}
    assert ends == {"long": (n, f"m{(n - 1) * 7919 % n}"), "short": (2, "a1"), "one": (1, "c0")}
    assert got.filter("scene_token = 'long'").join(order, got["sample_token"] == order["token"]).filter("place <> id").isEmpty()
    circle = spark.createDataFrame([("m0", "m1"), ("m1", "m0")], "token string, next string")
    with pytest.raises(ValueError, match="circle"):
        catalog.linked_order(scenes.limit(1), circle)


def test_scratch_tables_go(spark):
    from fleetgrid.sources import shared

    left = lambda: {p for p in os.listdir(shared.shared_folder(spark).removeprefix("file:")) if p.startswith("scratch")}
    before = left()
    with shared.scratch(spark) as put:
        put(spark.range(3))
        last = put(spark.range(4))
    folder = (left() - before).pop()
    assert last.count() == 4 and os.listdir(f"{shared.shared_folder(spark).removeprefix('file:')}/{folder}") == ["1"]
    with pytest.raises(ZeroDivisionError), shared.scratch(spark) as put:
        put(spark.range(3))
        1 / 0
    assert left() - before == {folder}


def test_quaternion_round_trip(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(50, 4))
    q = np.vstack([q / np.linalg.norm(q, axis=1)[:, None], np.eye(4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "i int, q array<double>")
    df = df.withColumn("r", g.quat_to_matrix(F.col("q"))).withColumn("back", g.matrix_to_quat(F.col("r")))
    for r in df.collect():
        m = np.reshape(r["r"], (3, 3))
        assert np.allclose(m @ m.T, np.eye(3)) and abs(abs(np.dot(r["q"], r["back"])) - 1) < 1e-9
