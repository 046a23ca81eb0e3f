"""Scenes, samples and frames: what there is, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..grid import FRAME
from ..sources.shared import scratch


def list_scenes(scenes: DataFrame) -> DataFrame:
    return scenes.select("name", "description", "nbr_samples")


def files_by_split(files: DataFrame) -> DataFrame:
    """Number of files of each split."""
    return files.groupBy("split").agg(F.count("*").alias("n_files"))


def scene_by_name(scenes: DataFrame, name: str) -> DataFrame:
    """The scene of that name; an unknown name is an error, raised here."""
    found = scenes.filter(F.col("name") == name)
    if found.isEmpty():
        raise ValueError(f"unknown scene: {name}")
    return found


def keyframes(samples: DataFrame, sample_data: DataFrame) -> DataFrame:
    """``scene_token, frame_idx, sample_token, data_token, filename``: roof-sensor key frames of each scene, in time order."""
    lidar = sample_data.filter(F.col("filename").contains("LIDAR_TOP") & F.col("is_key_frame"))
    lidar = lidar.groupBy("sample_token").agg(F.min_by(F.struct("token", "filename", "ego_pose_token", "calibrated_sensor_token"), "token").alias("d"))
    joined = samples.join(lidar, samples["token"] == lidar["sample_token"])
    place = F.row_number().over(Window.partitionBy("scene_token").orderBy("timestamp", "sample_token")) - 1
    return joined.select("scene_token", place.alias("frame_idx"), "sample_token", F.col("d.token").alias("data_token"), "d.filename", "d.ego_pose_token", "d.calibrated_sensor_token")


def linked_order(scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """``scene_token, sample_token, place``: samples in the order of their links, which may differ from time.

    Links are doubled: in each round the samples known of all scenes jump twice as far as before, so a chain of n samples takes
    log2(n) rounds, whatever its length. Rounds are written to the shared folder. Links end at a sample that isn't there or
    names no next; links that lead round in a circle are an error.
    """
    with scratch(scenes.sparkSession) as put:
        links = samples.filter("next <> ''").select(F.col("token").alias("at"), F.col("next").alias("to"))
        jumps = put(links.join(samples.select(F.col("token").alias("to")), "to").select("at", "to").distinct())
        most, far = samples.count(), 1
        walk = put(scenes.filter("first_sample_token <> ''").select(F.col("token").alias("scene_token"), F.col("first_sample_token").alias("sample_token"), F.lit(0).cast("long").alias("place")))
        while True:
            further = put(walk.join(jumps, walk["sample_token"] == jumps["at"]).select("scene_token", F.col("to").alias("sample_token"), (F.col("place") + far).alias("place")))
            if further.isEmpty():
                # the last table that is written stays
                return put(walk).select("scene_token", "sample_token", F.col("place").cast("int").alias("place"))
            if far > most:
                raise ValueError("links of samples lead round in a circle")
            walk = put(walk.unionByName(further))
            jumps = put(jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"))
            far *= 2


def with_lookups(keys: DataFrame, ego_pose: DataFrame, calibrated_sensor: DataFrame) -> DataFrame:
    """Key frames with the position and calibration that they name, as a frames table."""
    pose = ego_pose.select(F.col("token").alias("ego_pose_token"), g.quat_to_matrix(F.col("rotation")).alias("pose_r"), F.col("translation").alias("pose_t"))
    sensor = calibrated_sensor.select(F.col("token").alias("calibrated_sensor_token"), g.quat_to_matrix(F.col("rotation")).alias("calib_r"), F.col("translation").alias("calib_t"))
    return keys.join(pose, "ego_pose_token").join(sensor, "calibrated_sensor_token")


def annotations_of(keys: DataFrame, annotations: DataFrame) -> DataFrame:
    """Boxes of each key frame."""
    return keys.select("scene_token", "frame_idx", "sample_token").join(annotations, "sample_token")


def complete_frames(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames with both a scan and labels."""
    return scans.select(*FRAME).intersect(labels.select(*FRAME))


def sequences_with_poses(sequences: DataFrame, poses: DataFrame) -> DataFrame:
    return sequences.join(poses, "scene_id", "left_semi")


def usable_boxes(boxes: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Boxes of frames with calibration; other frames have no boxes, which is no error."""
    return boxes.join(calibrations.select(*FRAME).distinct(), FRAME, "left_semi")


def frames_without_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    return frames.join(boxes, FRAME, "left_anti")


def numbered(frames: DataFrame, order: str) -> DataFrame:
    """``frame_idx``: the place of each row in its scene."""
    return frames.withColumn("frame_idx", F.row_number().over(Window.partitionBy("dataset", "scene_id").orderBy(order)) - 1)


def frame_range(frames: DataFrame, start: int, n: int) -> DataFrame:
    """Frames start to start + n - 1 of each dataset, counted over its sorted frames.

    Scenes are counted first; the frames of a scene then know their place without one sort of all frames.
    """
    sizes = frames.groupBy("dataset", "scene_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dataset").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("dataset", "scene_id").orderBy("frame_idx")) - 1
    out = frames.join(sizes.select("dataset", "scene_id", before.alias("_before")), ["dataset", "scene_id"]).withColumn("_place", place + F.col("_before"))
    return out.filter(F.col("_place").between(start, start + n - 1)).drop("_before", "_place")


def nth_scan(frames: DataFrame, i: int) -> DataFrame:
    """Scan number ``i`` of each scene; if no scene has one, that is an error."""
    found = frames.filter(F.col("frame_idx") == i)
    if found.isEmpty():
        raise ValueError(f"scan {i} is out of range")
    return found


def one_interface(*tables: DataFrame) -> DataFrame:
    """Frames (or points, or boxes) of several datasets as one table; columns that one lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
