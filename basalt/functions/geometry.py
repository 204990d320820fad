"""Points, boxes, circles and paths as structs and arrays."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    """A box by its upper right and lower left corner, whatever corners are given."""
    return F.struct(point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("high"), point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"])).alias("low"))


def circle(c: Column, r: Column) -> Column:
    return F.struct(c.alias("center"), r.cast("double").alias("radius"))


def path(points: Column, closed: bool) -> Column:
    return F.struct(points.alias("points"), F.lit(closed).alias("closed"))


def width(b: Column) -> Column:
    return b["high"]["x"] - b["low"]["x"]


def height(b: Column) -> Column:
    return b["high"]["y"] - b["low"]["y"]


def box_area(b: Column) -> Column:
    return width(b) * height(b)


def circle_area(c: Column) -> Column:
    return F.lit(pi) * c["radius"] * c["radius"]


def box_center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def circle_center(c: Column) -> Column:
    return c["center"]


def radius(c: Column) -> Column:
    return c["radius"]


def diameter(c: Column) -> Column:
    return c["radius"] * 2


def npoints(p: Column) -> Column:
    return F.size(p["points"])


def isopen(p: Column) -> Column:
    return ~p["closed"]


def isclosed(p: Column) -> Column:
    return p["closed"]


def distance(a: Column, b: Column) -> Column:
    """a <-> b of points."""
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def box_contains(b: Column, p: Column) -> Column:
    """b @> p, borders included."""
    return (p["x"] >= b["low"]["x"]) & (p["x"] <= b["high"]["x"]) & (p["y"] >= b["low"]["y"]) & (p["y"] <= b["high"]["y"])


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def lseg(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def same_as(a: Column, b: Column) -> Column:
    """a ~= b of points."""
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def _direction(s: Column) -> tuple[Column, Column]:
    return s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]


def parallel(s: Column, t: Column) -> Column:
    (ax, ay), (bx, by) = _direction(s), _direction(t)
    return ax * by == ay * bx


def perpendicular(s: Column, t: Column) -> Column:
    (ax, ay), (bx, by) = _direction(s), _direction(t)
    return ax * bx + ay * by == 0


def intersects(s: Column, t: Column) -> Column:
    """s ?# t: two segments cross or touch, by the signs of four turns."""
    turn = lambda p, q, r: F.sign((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    within = lambda p, q, r: (r["x"] >= F.least(p["x"], q["x"])) & (r["x"] <= F.greatest(p["x"], q["x"])) & (r["y"] >= F.least(p["y"], q["y"])) & (r["y"] <= F.greatest(p["y"], q["y"]))
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    touch = ((o1 == 0) & within(a, b, c)) | ((o2 == 0) & within(a, b, d)) | ((o3 == 0) & within(c, d, a)) | ((o4 == 0) & within(c, d, b))
    return ((o1 != o2) & (o3 != o4)) | touch
