"""Rotations and rigid motions as column expressions. Angles in radians; a matrix is nine columns, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[Column]]


def lit(m) -> Matrix:
    return [[F.lit(float(v)) for v in row] for row in m]


def about(axis: str, angle: Column) -> Matrix:
    c, s, one, zero = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "y": [[c, zero, s], [zero, one, zero], [-s, zero, c]], "z": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def transpose(m: Matrix) -> Matrix:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def apply(m: Matrix, v: Sequence[Column]) -> list[Column]:
    return [m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3)]


def euler_zyx(roll: Column, pitch: Column, yaw: Column) -> Matrix:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    return multiply(multiply(about("z", yaw), about("y", pitch)), about("x", roll))


def euler_xyz(roll: Column, pitch: Column, yaw: Column) -> Matrix:
    """The opposite order, Rx(roll) Ry(pitch) Rz(yaw)."""
    return multiply(multiply(about("x", roll), about("y", pitch)), about("z", yaw))


def from_hrp(h: Sequence[Column], convention: str = "positional") -> Matrix:
    """Three stored angles: 'positional' takes them as (roll, pitch, yaw), 'named' as (heading, roll, pitch)."""
    return euler_zyx(h[0], h[1], h[2]) if convention == "positional" else euler_zyx(h[1], h[2], h[0])


def angles_zyx(m: Matrix) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw) of a matrix."""
    return F.atan2(m[2][1], m[2][2]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))), F.atan2(m[1][0], m[0][0])


def rigid(m: Matrix, t: Sequence[Column], v: Sequence[Column], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> list[Column]:
    """Rotates about a local origin, so that large coordinates keep their digits."""
    turned = apply(m, [c - o for c, o in zip(v, origin, strict=True)])
    return [r + o + s for r, o, s in zip(turned, origin, t, strict=True)]


def correct_pose(m: Matrix, t: Sequence[Column], dm: Matrix, dt: Sequence[Column]) -> tuple[Matrix, list[Column]]:
    """(R dR, t + R dt)."""
    return multiply(m, dm), [a + b for a, b in zip(t, apply(m, dt), strict=True)]


Quaternion = Sequence[Column]  # w, x, y, z


def quaternion_product(a: Quaternion, b: Quaternion) -> list[Column]:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def quaternion_of_euler(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    half = lambda axis, angle: [F.cos(angle / 2), *(F.sin(angle / 2) if a == axis else F.lit(0.0) for a in "xyz")]
    return quaternion_product(quaternion_product(half("z", yaw), half("y", pitch)), half("x", roll))


def quaternion_of_matrix(m: Matrix) -> list[Column]:
    """From the largest of the four sums, so that no divisor is small."""
    t = m[0][0] + m[1][1] + m[2][2]
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + t)) / 2
    x = F.sqrt(F.greatest(F.lit(0.0), 1 + m[0][0] - m[1][1] - m[2][2])) / 2
    y = F.sqrt(F.greatest(F.lit(0.0), 1 - m[0][0] + m[1][1] - m[2][2])) / 2
    z = F.sqrt(F.greatest(F.lit(0.0), 1 - m[0][0] - m[1][1] + m[2][2])) / 2
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    top = F.greatest(w, x, y, z)
    pick = lambda p, q, r, s: F.when(w == top, p).when(x == top, q).when(y == top, r).otherwise(s)
    return [pick(w, a / (4 * x), b / (4 * y), c / (4 * z)), pick(a / (4 * w), x, d / (4 * y), e / (4 * z)), pick(b / (4 * w), d / (4 * x), y, f / (4 * z)), pick(c / (4 * w), e / (4 * x), f / (4 * y), z)]


def matrix_of_quaternion(q: Quaternion) -> Matrix:
    w, x, y, z = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def slerp(a: Quaternion, b: Quaternion, t: Column, straight: float = 0.9995) -> list[Column]:
    """Shortest-arc interpolation; nearly equal rotations are interpolated linearly and normalised."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    c = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(c)
    s = F.sin(theta)
    wa = F.when(c > straight, 1 - t).otherwise(F.sin((1 - t) * theta) / s)
    wb = F.when(c > straight, t).otherwise(F.sin(t * theta) / s)
    mixed = [wa * p + wb * sign * q for p, q in zip(a, b, strict=True)]
    n = F.sqrt(sum((m * m for m in mixed[1:]), mixed[0] * mixed[0]))
    return [m / n for m in mixed]


def pose_difference(m: Matrix, t: Sequence[Column], wanted_m: Matrix, wanted_t: Sequence[Column]) -> list[Column]:
    """Wanted less given: position in millimetres, then roll, pitch and yaw in degrees."""
    angles = zip(angles_zyx(wanted_m), angles_zyx(m), strict=True)
    return [(w - g) * 1000.0 for w, g in zip(wanted_t, t, strict=True)] + [F.degrees(w - g) for w, g in angles]
