"""Oriented boxes, lines against segments, grids in polygons and placed footprints, as column expressions.

Points are structs (x, y); a box is an array of four of them in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.functions.geometry import between, cross, in_triangle, point_box_distance


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def turned(p: Column, angle: Column) -> Column:
    """A point rotated about the origin."""
    return point(F.cos(angle) * p["x"] - F.sin(angle) * p["y"], F.sin(angle) * p["x"] + F.cos(angle) * p["y"])


def oriented(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    """The corners of a box about a centre: a template turned and moved."""
    out = []
    for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        p = turned(point(sx * width, sy * height), angle)
        out.append(point(cx + p["x"], cy + p["y"]))
    return F.array(*out)


def box_pair_distance(rows: DataFrame, upright: Column, box: Column, name: str) -> DataFrame:
    """The rows with the distance of an upright box (its corners' extent) to an oriented one, edge by edge of the latter.

    The upright box's corners are projected on an edge's line; if that nearest to the box lies on the edge, its distance
    counts, else those of the edge's ends. Vertical edges, which have no slope, are left out; without any other, null.
    """
    side = lambda f, c: f(F.transform("_u", lambda p: p[c]))
    x = {f"{n}_{c}": side(f, c) for c in "xy" for n, f in (("low", F.array_min), ("high", F.array_max))}
    away = lambda px, py: point_box_distance(px, py, *[F.col("_x")[k] for k in ("low_x", "low_y", "high_x", "high_y")])
    ends = lambda i: {"ax": F.col("_b")[i]["x"], "ay": F.col("_b")[i]["y"], "bx": F.col("_b")[(i + 1) % 4]["x"], "by": F.col("_b")[(i + 1) % 4]["y"]}
    rows = rows.withColumns({"_u": upright, "_b": box}).withColumn("_x", F.struct(*[v.alias(k) for k, v in x.items()]))
    edges = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(*[v.alias(k) for k, v in ends(i).items()]))
    rows = rows.withColumn("_e", F.filter(edges, lambda e: e["ax"] != e["bx"]))

    def foot(e: Column, p: Column, k: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = ((p["x"] - e["ax"]) * dx + (p["y"] - e["ay"]) * dy) / (dx * dx + dy * dy)
        return F.struct(F.round(away(e["ax"] + along * dx, e["ay"] + along * dy), 12).alias("away"), k.alias("k"), along.alias("along"))

    nearest = lambda e: F.array_min(F.transform("_u", lambda p, k: foot(e, p, k)))
    rows = rows.withColumn("_f", F.transform("_e", lambda e: F.struct(e.alias("e"), nearest(e).alias("n"))))
    value = lambda f: F.when((f["n"]["along"] > 0) & (f["n"]["along"] < 1), f["n"]["away"]).otherwise(
        F.least(away(f["e"]["ax"], f["e"]["ay"]), away(f["e"]["bx"], f["e"]["by"])))
    return rows.withColumn(name, F.array_min(F.transform("_f", value))).drop("_u", "_b", "_x", "_e", "_f")


def rotated_box_distance(rows: DataFrame, angle: Column, first: Column, second: Column, name: str) -> DataFrame:
    """``box_pair_distance`` after both boxes are rotated; 0 if their corners coincide within 1e-10."""
    turn = lambda box: F.transform(box, lambda p: turned(p, angle))
    rows = rows.withColumns({"_p": turn(first), "_q": turn(second)})
    near = lambda z: (F.abs(z["_p"]["x"] - z["_q"]["x"]) <= 1e-10) & (F.abs(z["_p"]["y"] - z["_q"]["y"]) <= 1e-10)
    found = box_pair_distance(rows, F.col("_p"), F.col("_q"), name)
    return found.withColumn(name, F.when(F.forall(F.arrays_zip("_p", "_q"), near), 0.0).otherwise(F.col(name))).drop("_p", "_q")


def line_hits(rows: DataFrame, line: tuple[Column, Column], segments: Column) -> DataFrame:
    """The rows with (segment, x, y) for every segment (a, b) of the array that the line through two points meets.

    Parallel segments are dropped.
    """
    each = rows.select("*", F.posexplode(segments).alias("segment", "_s"))
    (p, q), a, b = line, F.col("_s.a"), F.col("_s.b")
    den = cross(q["x"] - p["x"], q["y"] - p["y"], b["x"] - a["x"], b["y"] - a["y"])
    t = F.try_divide(cross(a["x"] - p["x"], a["y"] - p["y"], b["x"] - a["x"], b["y"] - a["y"]), den)
    met = each.withColumns({"x": p["x"] + t * (q["x"] - p["x"]), "y": p["y"] + t * (q["y"] - p["y"])})
    on = between((F.col("x"), F.col("y")), (a["x"], a["y"]), (b["x"], b["y"]))
    return met.where(F.col("x").isNotNull() & on).drop("_s")


def grid_points(triangles: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(key, x, y): points of a grid that lie in any triangle of a key's (key, a, b, c) rows.

    The grid runs over the bounds of all the key's corners, rounded away from zero, both ends included. A triangle looks
    only at the grid's points about its own bounds, in its own row; its key's bounds come by a merge, so nothing is
    sent through the driver.
    """
    corner = F.explode(F.array("a", "b", "c"))
    away = lambda c: F.when(c > 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.ceil(F.abs(c))
    bounds = triangles.select("key", corner.alias("p")).groupBy("key").agg(*[f(f"p.{c}").alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))])
    bounds = bounds.select("key", *[away(F.col(f"low_{c}")).alias(f"from_{c}") for c in "xy"], *[F.floor((away(F.col(f"high_{c}")) - away(F.col(f"low_{c}"))) / spacing).cast("int").alias(f"last_{c}") for c in "xy"])

    def steps(c: str) -> Column:
        """Numbers of the grid's lines about a triangle, one more on either side for what rounding may do."""
        ends = [F.col(f"{p}.{c}") for p in "abc"]
        low, high = (F.floor((f(*ends) - F.col(f"from_{c}")) / spacing) for f in (F.least, F.greatest))
        first, last = F.greatest(low - 1, F.lit(0)).cast("int"), F.least(high + 2, F.col(f"last_{c}")).cast("int")
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    met = triangles.select("key", "a", "b", "c").join(bounds.hint("merge"), "key").withColumn("i", steps("x")).withColumn("j", steps("y"))
    met = met.select("key", "a", "b", "c", *[(F.col(f"from_{c}") + spacing * F.col(n)).alias(c) for c, n in (("x", "i"), ("y", "j"))])
    of = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"))
    inside = in_triangle((F.col("x"), F.col("y")), of("a"), of("b"), of("c"))
    return met.where(inside).select("key", "x", "y").distinct()


def edge_samples(box: str, parts: int) -> Column:
    """Points at even steps along every edge of a column's box, both ends included, edge by edge."""
    box, steps = F.col(box), F.sequence(F.lit(0), F.lit(parts))
    along = lambda i, k, c: box[i][c] + k / parts * (box[(i + 1) % 4][c] - box[i][c])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(steps, lambda k: point(along(i, k, "x"), along(i, k, "y")))))


def rescaled(box: str, amounts: str) -> Column:
    """A column's box whose edges are moved outwards along the neighbouring edges' directions by an amount each."""
    box, amounts = F.col(box), F.col(amounts)

    def push(i: Column, c: str) -> Column:
        a, b = box[i], box[(i + 3) % 4]
        return (a[c] - b[c]) / F.hypot(a["x"] - b["x"], a["y"] - b["y"]) * amounts[i]

    moved = lambda i, c: box[i][c] + push(i, c) + push((i + 3) % 4, c)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: point(moved(i, "x"), moved(i, "y")))
