"""Plane and space geometry as column expressions; small matrices are built on the driver."""

from __future__ import annotations

from math import cos, sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (x, y); 0 for fewer than three."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2)


def point_box_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to an upright box; 0 inside."""
    dx, dy = F.greatest(x0 - px, F.lit(0.0), px - x1), F.greatest(y0 - py, F.lit(0.0), py - y1)
    return F.sqrt(dx * dx + dy * dy)


def intersection(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[Column, Column]:
    """Where the lines ab and cd meet; parallel lines are an error."""
    den = cross(b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1])
    den = F.when(den == 0, F.raise_error(F.lit("parallel lines")).cast("double")).otherwise(den)
    t = cross(c[0] - a[0], c[1] - a[1], d[0] - c[0], d[1] - c[1]) / den
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def between(a: tuple, b: tuple, c: tuple) -> Column:
    """Whether a lies on the segment bc, within 1e-10."""
    return F.abs(F.hypot(a[0] - b[0], a[1] - b[1]) + F.hypot(a[0] - c[0], a[1] - c[1]) - F.hypot(b[0] - c[0], b[1] - c[1])) < 1e-10


def in_triangle(p: tuple, a: tuple, b: tuple, c: tuple, strict: bool = True) -> Column:
    """Whether p lies in a triangle of either turn; ``strict`` leaves the edges out."""
    signs = [cross(q[0] - o[0], q[1] - o[1], p[0] - o[0], p[1] - o[1]) for o, q in ((a, b), (b, c), (c, a))]
    low, high = F.least(*signs), F.greatest(*signs)
    return (low > 0) | (high < 0) if strict else (low >= -1e-7) | (high <= 1e-7)


def convex(a: tuple, b: tuple, c: tuple) -> Column:
    return cross(b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]) >= 0


def signed_area(points: Column) -> Column:
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"]), F.lit(0.0), lambda a, b: a + b) / 2


def clockwise(points: Column) -> Column:
    return signed_area(points) < 0


def project_on_segment(p: tuple, a: tuple, b: tuple) -> tuple[Column, Column]:
    """The foot of p on the line ab, not clamped to the segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)
    return a[0] + t * dx, a[1] + t * dy


def homography(matrix: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    """A 3 x 3 transform of plane points, with the perspective divide."""
    u, v, w = (float(r[0]) * x + float(r[1]) * y + float(r[2]) for r in np.asarray(matrix))
    return u / w, v / w


def project(matrix: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A 4 x 4 transform of space points, with the homogeneous divide."""
    rows = [float(r[0]) * x + float(r[1]) * y + float(r[2]) * z + float(r[3]) for r in np.asarray(matrix)]
    return rows[0] / rows[3], rows[1] / rows[3], rows[2] / rows[3]


def axis_angle(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """The 4 x 4 rotation about an axis through the origin."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    out = np.eye(4)
    out[:3, :3] += sin(angle) * k + (1 - cos(angle)) * k @ k
    return out


def rotation_about(axis: tuple[float, float, float], angle: float, centre: tuple[float, float, float]) -> np.ndarray:
    there, back = np.eye(4), np.eye(4)
    there[:3, 3], back[:3, 3] = np.negative(centre), centre
    return back @ axis_angle(axis, angle) @ there


def angle_between(a: tuple, b: tuple) -> Column:
    """Degrees between unit vectors, their product clipped to [-1, 1]."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def ray_plane(origin: tuple, ray: tuple, point: tuple, normal: tuple) -> Column:
    """The ray's parameter at the plane, negative ones too; null if the ray runs along it."""
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    along = dot(ray, normal)
    away = dot(tuple(p - o for p, o in zip(point, origin, strict=True)), normal)
    return F.when(F.abs(along) > 1e-10, away / along)


def look_at(eye: tuple[float, float, float], target: tuple[float, float, float], focal: float, centre: tuple[float, float]) -> np.ndarray:
    """The 3 x 4 projection of a camera that looks at a target, z up; depths are positive in front of it."""
    forward = np.subtract(target, eye) / np.linalg.norm(np.subtract(target, eye))
    right = np.cross(forward, (0.0, 0.0, 1.0)) / np.linalg.norm(np.cross(forward, (0.0, 0.0, 1.0)))
    turn = np.array([right, np.cross(forward, right), forward])
    inner = np.array([[focal, 0, centre[0]], [0, focal, centre[1]], [0, 0, 1]])
    return inner @ np.column_stack((turn, -turn @ np.asarray(eye, float)))
