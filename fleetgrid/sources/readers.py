"""Readers of driving datasets' files, and tables of results.

Files are read by Spark alone, so they may lie in any store that it reaches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hadoop

NUMBERS = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()

#: Schemas of the metadata tables, a JSON array in a file each.
METADATA = {
    "scene": _struct(token=_S, name=_S, description=_S, nbr_samples=_I, first_sample_token=_S),
    "sample": _struct(token=_S, next=_S, scene_token=_S, timestamp=_L),
    "sample_data": _struct(token=_S, sample_token=_S, filename=_S, is_key_frame=_B, ego_pose_token=_S, calibrated_sensor_token=_S),
    "ego_pose": _struct(token=_S, translation=NUMBERS, rotation=NUMBERS),
    "calibrated_sensor": _struct(token=_S, translation=NUMBERS, rotation=NUMBERS),
    "sample_annotation": _struct(token=_S, sample_token=_S, translation=NUMBERS, size=NUMBERS, rotation=NUMBERS),
}

#: Object classes that the strict label reader keeps.
CLASSES = ("Car", "Van", "Truck", "Pedestrian", "Cyclist", "Tram")


def read_metadata(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All metadata tables by name."""
    return {name: spark.read.schema(schema).option("multiLine", True).json(f"{root}/{name}.json") for name, schema in METADATA.items()}


def read_points(spark: SparkSession, paths: str | Sequence[str], n_cols: int) -> DataFrame:
    """``path, point_idx, x, y, z, intensity, ring`` from scans of little-endian float32 records of 4 or 5 numbers.

    Each file is one row for Spark (see decode_points); for large files there is ScanSource, which reads ranges of them. Write the
    result as Parquet once rather than decode scans again.
    """
    return decode_points(spark.read.format("binaryFile").load(paths), n_cols)


def decode_points(files: DataFrame, n_cols: int) -> DataFrame:
    """The points of ``path, content``, a row for each scan, decoded in slices; ``ring`` is NULL for records of 4.

    A scan whose size is no multiple of a record is an error.
    """
    if n_cols not in (4, 5):
        raise ValueError("scans have 4 or 5 numbers a point")
    most = 200_000

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                for a in range(0, max(data.size, 1), most * 4 * n_cols):
                    yield point_batch(path.as_py(), data[a : a + most * 4 * n_cols], n_cols, a // (4 * n_cols))

    return files.select("path", "content").mapInArrow(decode, POINTS)


POINTS = "path string, point_idx long, x float, y float, z float, intensity float, ring float"


def point_batch(path: str, data: pa.Buffer, n_cols: int, first: int) -> pa.RecordBatch:
    """Records of a scan as rows of POINTS, the ``first`` of which is given."""
    records = np.frombuffer(data, dtype="<f4").reshape(-1, n_cols)
    n = len(records)
    ring = pa.array(np.ascontiguousarray(records[:, 4])) if n_cols == 5 else pa.nulls(n, pa.float32())
    columns = [pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), *(pa.array(np.ascontiguousarray(records[:, i])) for i in range(4)), ring]
    return pa.RecordBatch.from_arrays(columns, names=["path", "point_idx", "x", "y", "z", "intensity", "ring"])


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, line, n`` with lines numbered from 0 inside their file; files are small text files."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return files.select("path", "n", F.trim("line").alias("line"))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))


def read_calib(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The named matrices of each calibration file (see calib_of)."""
    return calib_of(_lines(spark, paths))


def calib_of(lines: DataFrame) -> DataFrame:
    """``path, m``: the named matrices of each file of ``path, n, line`` as a map to lists of numbers. Lines without a colon are
    skipped; of a name that is repeated the last counts."""
    rows = lines.filter(F.col("line").contains(":"))
    name, values = F.trim(F.substring_index("line", ":", 1)), F.expr("substring(line, locate(':', line) + 1)")
    rows = rows.select("path", "n", name.alias("name"), _numbers(values).alias("values"))
    last = rows.groupBy("path", "name").agg(F.max_by("values", "n").alias("values"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("m"))


def with_sensor_matrix(calib: DataFrame) -> DataFrame:
    """``tr``: the sensor-to-camera matrix under any of its names; none is an error when the row is read."""
    found = F.coalesce(*(F.try_element_at("m", F.lit(k)) for k in ("Tr", "Tr_velo_to_cam", "Tr_velo_cam")))
    missing = F.raise_error(F.concat(F.lit("no sensor-to-camera matrix in "), "path")).cast(NUMBERS)
    return calib.withColumn("tr", F.when(found.isNull(), missing).otherwise(found))


def read_labels(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """The boxes of label files (see labels_of)."""
    return labels_of(_lines(spark, paths), strict)


def labels_of(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``path, box_id, class, h, w, l, x, y, z, rotation_y`` of the ``path, n, line`` of label files.

    ``strict`` keeps CLASSES and lines of 15 fields or more; otherwise all classes but DontCare whose numbers parse are kept.
    """
    rows = lines.filter("line <> ''").withColumn("f", F.split("line", r"\s+"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    out = rows.select("path", F.col("n").alias("box_id"), F.get("f", F.lit(0)).alias("class"), F.size("f").alias("_n"), *(number(8 + i).alias(c) for i, c in enumerate(("h", "w", "l", "x", "y", "z", "rotation_y"))))
    whole = F.col("_n") >= 15
    if strict:
        out = out.filter(whole & F.col("class").isin(*CLASSES))
    else:
        out = out.filter((F.col("class") != "DontCare") & F.forall(F.array("h", "w", "l", "x", "y", "z", "rotation_y"), lambda v: v.isNotNull()))
    return out.drop("_n")


def read_poses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The positions of pose files (see poses_of)."""
    return poses_of(_lines(spark, paths))


def poses_of(lines: DataFrame) -> DataFrame:
    """``path, frame_idx, p`` of ``path, n, line``: 3x4 matrices; lines that aren't 12 numbers are skipped and don't count."""
    rows = lines.withColumn("p", _numbers(F.col("line"))).filter((F.size("p") == 12) & F.forall("p", lambda v: v.isNotNull()))
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).alias("frame_idx"), "p")


RESULTS = (
    "run_ts timestamp, dataset string, scene_id string, frame_idx int, tier string, mode string, beta double, w int, cell_size double, "
    "occupied_pct double, iobb double, nmse double, precision double, n_objects long, iters int, converged boolean, elapsed_s double, error string"
)


def append_results(df: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Adds the rows of a run to the results log; columns of RESULTS that ``df`` lacks are NULL. Returns whether they were added.

    Rows are written first, under a name of this attempt; then the run is committed by a file that names the attempt, which is made
    only if there is none. So a run that is added again, by another job too, or one that died before it was committed, never
    doubles rows and never shows part of them. Without ``run_id`` each call is a run of its own.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    run = attempt if run_id is None else run_id
    files, at = hadoop(spark, f"{path}/runs/{hashlib.sha256(run.encode()).hexdigest()}.json")
    if files.exists(at):
        return False
    schema = T.StructType.fromDDL(RESULTS)
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", "dataset").parquet(f"{path}/rows")
    return _commit(files, at, {"run": run, "attempt": attempt})


def _commit(files, at, entry: dict) -> bool:
    """Makes the file of a run, unless there is one."""
    try:
        out = files.create(at, False)
    except Py4JJavaError:
        if files.exists(at):
            return False
        raise
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs that are committed; rows of other attempts aren't read."""
    runs = spark.read.schema("run string, attempt string").json(f"{path}/runs")
    rows = spark.read.schema(f"{RESULTS}, attempt string").parquet(f"{path}/rows")
    return rows.join(runs.select("attempt"), "attempt", "left_semi").select(*T.StructType.fromDDL(RESULTS).names)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces a report table."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def latest(reports: DataFrame, kind: str = "kind", at: str = "run_ts") -> DataFrame:
    """The rows of the latest run of each kind of report."""
    newest = reports.groupBy(kind).agg(F.max(at).alias("_newest"))
    return reports.join(newest, kind).filter(F.col(at) == F.col("_newest")).drop("_newest")
