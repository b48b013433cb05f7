"""Box volumes on the ground before a camera, and poses of cameras, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cinefold.functions.geometry import cross


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out a single time, however often it is named."""
    return F.transform(F.array(value), use)[0]


def placed(width: Column, length: Column, height: Column, x: Column, y: Column, turn: Column) -> Column:
    """The eight corners (x, y, z) of a volume that stands on the ground: four below, then four above, each in turn.

    Its length runs along x before it is turned, clockwise as seen from above; a footprint is a volume of no height.
    """
    facts = F.struct(width.alias("w"), length.alias("l"), height.alias("h"), x.alias("x"), y.alias("y"), F.cos(turn).alias("cos"), F.sin(turn).alias("sin"))
    template = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(up).alias("up")) for up in (0.0, 1.0) for a, b in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))])

    def corner(f: Column, t: Column) -> Column:
        u, v = t["a"] * f["l"], t["b"] * f["w"]
        return F.struct((f["x"] + f["cos"] * u + f["sin"] * v).alias("x"), (f["y"] - f["sin"] * u + f["cos"] * v).alias("y"), (t["up"] * f["h"]).alias("z"))

    return once(facts, lambda f: F.transform(template, lambda t: corner(f, t)))


def seen(camera: np.ndarray, p: Column) -> Column:
    """A space point's place (x, y) in the image of a 3 x 4 projection."""
    u, v, w = (float(r[0]) * p["x"] + float(r[1]) * p["y"] + float(r[2]) * p["z"] + float(r[3]) for r in np.asarray(camera))
    return F.struct((u / w).alias("x"), (v / w).alias("y"))


def extent(camera: np.ndarray, corners: Column) -> Column:
    """(left, top, right, bottom) of corners in the image."""
    sides = (("left", F.array_min, "x"), ("top", F.array_min, "y"), ("right", F.array_max, "x"), ("bottom", F.array_max, "y"))
    return once(F.transform(corners, lambda p: seen(camera, p)), lambda flat: F.struct(*[f(F.transform(flat, lambda p: p[c])).alias(n) for n, f, c in sides]))  # noqa: B023


def extent_loss(box: Column, other: Column) -> Column:
    """log(1 + the summed distances of two boxes' corners)."""
    ends = [(h, v) for v in ("top", "bottom") for h in ("left", "right")]
    gaps = [F.hypot(box[h] - other[h], box[v] - other[v]) for h, v in ends]
    return F.log1p(gaps[0] + gaps[1] + gaps[2] + gaps[3])


def shape_prior(width: Column, length: Column, height: Column, wide: float = 0.43, high: float = 0.36) -> Column:
    """The logs of one and half the squared differences of width and height from their shares of the length."""
    off = lambda size, share: F.log1p(F.pow(size / length - share, F.lit(2)) / 2)
    return off(width, wide) + off(height, high)


def hidden(corners: Column, k: int, eye: tuple[float, float]) -> Column:
    """Whether the footprint itself hides its corner k (from 0) from an eye, both on the ground.

    It does where the sight line meets one of the two edges without that corner, ends included, nearer to the eye.
    """
    p, (ex, ey) = corners[k], eye
    out = []
    for i in ((k + 1) % 4, (k + 2) % 4):
        a, b = corners[i], corners[(i + 1) % 4]
        dx, dy, sx, sy = F.lit(ex) - p["x"], F.lit(ey) - p["y"], b["x"] - a["x"], b["y"] - a["y"]
        den = cross(dx, dy, sx, sy)
        at = F.try_divide(cross(a["x"] - p["x"], a["y"] - p["y"], sx, sy), den)  # along the sight line: 0 at the corner, 1 at the eye
        on = F.try_divide(cross(a["x"] - p["x"], a["y"] - p["y"], dx, dy), den)
        out.append(F.coalesce((at > 0) & (at < 2) & (on >= 0) & (on <= 1), F.lit(False)))
    return out[0] | out[1]


def euler_extrinsics(alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The 4 x 4 extrinsics of turns about x, y and z, in this order, then mirrored in x and one unit back along z."""
    x = np.array([[1, 0, 0], [0, cos(alpha), -sin(alpha)], [0, sin(alpha), cos(alpha)]])
    y = np.array([[cos(beta), 0, sin(beta)], [0, 1, 0], [-sin(beta), 0, cos(beta)]])
    z = np.array([[cos(gamma), -sin(gamma), 0], [sin(gamma), cos(gamma), 0], [0, 0, 1]])
    out = np.eye(4)
    out[:3, :3] = np.diag((-1.0, 1.0, 1.0)) @ x @ y @ z
    out[2, 3] = -1.0
    return out


def on_ground(camera: np.ndarray, u: Column, v: Column) -> tuple[Column, Column]:
    """The ground point (x, y) at an image place, for a 3 x 4 projection: the plane z = 0 seen backwards."""
    back = np.linalg.inv(np.asarray(camera, float)[:, [0, 1, 3]])
    x, y, w = (float(r[0]) * u + float(r[1]) * v + float(r[2]) for r in back)
    return x / w, y / w


def pixel_ray(camera: np.ndarray, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """The unit direction from a camera's eye through an image place."""
    back = np.linalg.inv(np.asarray(camera, float)[:, :3])
    ray = [float(r[0]) * u + float(r[1]) * v + float(r[2]) for r in back]
    size = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
    return ray[0] / size, ray[1] / size, ray[2] / size


def eye_of(camera: np.ndarray) -> tuple[float, float, float]:
    """Where the camera of a 3 x 4 projection is."""
    m = np.asarray(camera, float)
    return tuple(float(x) for x in -np.linalg.inv(m[:, :3]) @ m[:, 3])


def pose_of(h: Column) -> Column:
    """The 3 x 4 pose (12 numbers, by rows) of a homography (9 numbers, by rows) of a camera whose own parameters are undone.

    The first two columns at unit length, their cross product, and the third over the mean of their lengths.
    """
    size = lambda k: F.sqrt(h[k] * h[k] + h[3 + k] * h[3 + k] + h[6 + k] * h[6 + k])
    a, b = [h[3 * r] / size(0) for r in range(3)], [h[3 * r + 1] / size(1) for r in range(3)]
    c = [a[(r + 1) % 3] * b[(r + 2) % 3] - a[(r + 2) % 3] * b[(r + 1) % 3] for r in range(3)]
    t = [h[3 * r + 2] / ((size(0) + size(1)) / 2) for r in range(3)]
    return F.array(*[x for r in range(3) for x in (a[r], b[r], c[r], t[r])])
