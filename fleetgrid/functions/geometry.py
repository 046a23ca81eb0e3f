"""Geometry and map values as Column expressions. Rotations are arrays of 9 numbers, row by row; translations of 3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import EVIDENCE, LIMIT, Grid

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
#: Camera axes (right, down, forward) to ego axes as the camera-based frames use them (right, forward, up).
CAMERA_TO_EGO = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0)
#: Heights kept (metres), least distance, height of the roof sensor in frames without calibration.
LOW, HIGH, NEAR, ROOF = 0.3, 3.0, 1.5, 1.73

Matrix = Column | Sequence[float | Column]


def _at(m: Matrix, i: int) -> Column:
    return m[i] if isinstance(m[i], Column) else F.lit(float(m[i]))


def quat_to_matrix(q: Column) -> Column:
    """Rotation matrix of a quaternion [w, x, y, z] of any length but zero."""
    w, x, y, z = (q[i] for i in range(4))
    s = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    return F.array(
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


def matrix_to_quat(r: Column) -> Column:
    """A unit quaternion [w, x, y, z] of a rotation; its sign is free. The largest component is taken by a root."""
    m = [[r[3 * i + j] for j in range(3)] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]

    def about(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(1 + m[i][i] - m[j][j] - m[k][k])
        part = {i: s / 4, j: (m[i][j] + m[j][i]) / s, k: (m[i][k] + m[k][i]) / s}
        return F.array((m[k][j] - m[j][k]) / s, part[0], part[1], part[2])

    s = 2 * F.sqrt(1 + trace)
    whole = F.array(s / 4, (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s)
    return F.when(trace > 0, whole).when((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), about(0)).when(m[1][1] >= m[2][2], about(1)).otherwise(about(2))


def turned(r: Matrix) -> list[Column]:
    """The elements of a transposed matrix, which say less than an array of them where they are used one by one."""
    return [_at(r, 3 * j + i) for i in range(3) for j in range(3)]


def transpose(r: Matrix) -> Column:
    return F.array(*turned(r))


def product(a: Matrix, b: Matrix) -> list[Column]:
    """The elements of a matrix product."""
    return [_at(a, 3 * i) * _at(b, j) + _at(a, 3 * i + 1) * _at(b, 3 + j) + _at(a, 3 * i + 2) * _at(b, 6 + j) for i in range(3) for j in range(3)]


def matmul(a: Matrix, b: Matrix) -> Column:
    return F.array(*product(a, b))


def rotate(r: Matrix, v: Sequence[Column]) -> list[Column]:
    return [_at(r, 3 * i) * v[0] + _at(r, 3 * i + 1) * v[1] + _at(r, 3 * i + 2) * v[2] for i in range(3)]


def apply(r: Matrix, t: Matrix, v: Sequence[Column]) -> list[Column]:
    """r v + t."""
    return [p + _at(t, i) for i, p in enumerate(rotate(r, v))]


def split_3x4(m: Column) -> tuple[Column, Column]:
    """Rotation and translation of a 3x4 matrix (12 numbers)."""
    return F.array(*(m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10))), F.array(m[3], m[7], m[11])


def camera_calibration(tr: Column) -> tuple[Column, Column]:
    """Sensor to ego from a sensor-to-camera matrix (3x4): origin at the camera, ego axes."""
    r, t = split_3x4(tr)
    return matmul(CAMERA_TO_EGO, r), F.array(*rotate(CAMERA_TO_EGO, [t[i] for i in range(3)]))


def camera_pose(p: Column) -> tuple[Column, Column]:
    """Ego to world from a camera-to-world matrix (3x4)."""
    r, t = split_3x4(p)
    return matmul(r, transpose(CAMERA_TO_EGO)), t


def ego_to_ego(v: Sequence[Column], r_j: Matrix, t_j: Matrix, r_k: Matrix, t_k: Matrix) -> list[Column]:
    """A point of frame j in frame k, rounded to single precision."""
    return from_world(apply(r_j, t_j, v), r_k, t_k)


def from_world(world: Sequence[Column], r_k: Matrix, t_k: Matrix) -> list[Column]:
    """A point of the world in frame k, rounded to single precision."""
    return [c.cast("float") for c in rotate(turned(r_k), [world[i] - _at(t_k, i) for i in range(3)])]


def height_ok(z: Column) -> Column:
    return z.between(F.lit(LOW).cast("float"), F.lit(HIGH).cast("float"))


def above_ground(z: Column) -> Column:
    return z >= F.lit(LOW).cast("float")


def range_ok(x: Column, y: Column, grid: Grid) -> Column:
    """Inside the map, and far enough to be no part of the vehicle."""
    radial = F.sqrt(x.cast("double") * x + y.cast("double") * y)
    return (F.abs(x) <= grid.half) & (F.abs(y) <= grid.half) & (radial >= NEAR)


def _clip(c: Column, grid: Grid) -> Column:
    return F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(grid.size - 1))


def col_of(x: Column, grid: Grid) -> Column:
    """Column of the cell, in the precision of x; the far edge belongs to the last cell."""
    return _clip(F.floor((x + F.lit(grid.half).cast("float")) / F.lit(grid.cell).cast("float")), grid)


def row_of(y: Column, grid: Grid) -> Column:
    return _clip(F.floor((F.lit(grid.half).cast("float") - y) / F.lit(grid.cell).cast("float")), grid)


def angle_bin(x: Column, y: Column, bins: int = 360) -> Column:
    """Bearing as one of ``bins`` bins from -pi on; an angle of exactly pi falls into bin 0."""
    width = F.lit(2.0) * F.pi() / bins
    return ((F.atan2(y.cast("double"), x.cast("double")) + F.pi()) / width).cast("int") % bins


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(x.cast("double") * x.cast("double") + y.cast("double") * y.cast("double"))


def sector(x: Column, y: Column, sectors: int) -> Column:
    """One of ``sectors`` sectors by bearing, counted from the x axis."""
    full = F.lit(2.0) * F.pi()
    return (F.floor(F.pmod(F.atan2(y.cast("double"), x.cast("double")) + full, full) / (full / sectors)).cast("int")) % sectors


def yaw_of(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def corners(cx: Column, cy: Column, w: Column, l: Column, yaw: Column) -> Column:  # noqa: E741
    """The four corners of a box from above, as (x, y) structs, against the clock from front left."""
    c, s = F.cos(yaw), F.sin(yaw)
    out = []
    for a, b in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)):
        out.append(F.struct((c * (a * l) - s * (b * w) + cx).alias("x"), (s * (a * l) + c * (b * w) + cy).alias("y")))
    return F.array(*out)


def label_to_ego(location: Sequence[Column], rotation_y: Column, r0: Matrix, tr: Column, height: float = ROOF) -> tuple[list[Column], Column]:
    """Centre and yaw in ego axes of a label in camera coordinates: the camera's rotation is undone, the sensor's height added."""
    r_v, t_v = split_3x4(tr)
    back = turned(product(r0, r_v))
    moved = rotate(back, rotate(r0, [t_v[i] for i in range(3)]))
    at = rotate(back, location)
    centre = [a - m for a, m in zip(at, moved, strict=True)]
    heading = rotate(back, [F.sin(rotation_y), F.lit(0.0), F.cos(rotation_y)])
    return [centre[0], centre[1], centre[2] + height], F.atan2(heading[1], heading[0])


def yaw_quat(yaw: Column) -> Column:
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def scan_log_odds(n: Column, free: Column) -> Column:
    """Log-odds of one scan from its hits in a cell and whether a ray passed. Hits saturate; a pass counts once and after them.

    Hits less passes are multiplied once, so that one hit and one pass are exactly unknown.
    """
    full = n * EVIDENCE >= LIMIT
    return F.when(full, LIMIT - EVIDENCE * free).otherwise(EVIDENCE * (n - free))


def fold_step(before: Column, n: Column, free: Column) -> Column:
    """Log-odds of a cell after one more scan."""
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), before + n * EVIDENCE) - free * EVIDENCE)


def probability(log_odds: Column) -> Column:
    """Occupancy in single precision, in which maps are compared to thresholds."""
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))).cast("float")


def occupied(p: Column, threshold: float = 0.5) -> Column:
    return p.cast("float") > F.lit(threshold).cast("float")


def clipped(mu: Column) -> Column:
    return F.least(F.greatest(mu, F.lit(0.0)), F.lit(1.0))


def log_odds_of(p: Column, least: float = 1e-6) -> Column:
    """Log-odds of a probability, kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(q / (1 - q))
