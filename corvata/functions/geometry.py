"""Boxes, polygons and plane transforms as column arithmetic. A box is STRUCT<l,t,r,b DOUBLE>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvata.functions.money import let


def bounds(polygon: Column) -> Column:
    """The box around ARRAY<STRUCT<x,y>>; null if it has no points."""
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.when(F.size(polygon) > 0, F.struct(F.array_min(x).alias("l"), F.array_min(y).alias("t"), F.array_max(x).alias("r"), F.array_max(y).alias("b")))


def area(b: Column) -> Column:
    return F.greatest(b["r"] - b["l"], F.lit(0.0)) * F.greatest(b["b"] - b["t"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]), F.lit(0.0)) * F.greatest(F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for degenerate boxes."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre_in(inner: Column, outer: Column) -> Column:
    x, y = (inner["l"] + inner["r"]) / 2, (inner["t"] + inner["b"]) / 2
    return (x >= outer["l"]) & (x <= outer["r"]) & (y >= outer["t"]) & (y <= outer["b"])


def centre_proximity(a: Column, b: Column, width: Column, height: Column) -> Column:
    """1 for one centre, falling to 0 at the page's diagonal."""
    d = F.hypot((a["l"] + a["r"] - b["l"] - b["r"]) / 2, (a["t"] + a["b"] - b["t"] - b["b"]) / 2)
    return F.greatest(F.lit(0.0), 1 - d / F.hypot(width, height))


def shoelace(polygon: Column) -> Column:
    """Area of a simple polygon; an expression that makes the polygon runs once, not once a point."""

    def of(p: Column) -> Column:
        n = F.size(p)
        step = lambda acc, i: acc + p[i]["x"] * p[(i + 1) % n]["y"] - p[(i + 1) % n]["x"] * p[i]["y"]
        return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step)) / 2).otherwise(0.0)

    return let(polygon, of)


def project(h: Column, x: Column, y: Column) -> Column:
    """The point under a 3x3 transform given as an array of nine; null where it is at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.when(F.abs(w) > 1e-12, F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y")))


def compose(a: Column, b: Column) -> Column:
    """First b, then a."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def invert(h: pd.Series) -> pd.Series:
    """The inverse of a 3x3 transform; null if it has none."""

    def one(v):
        m = np.array(v, float).reshape(3, 3)
        return None if abs(np.linalg.det(m)) < 1e-12 else np.linalg.inv(m).reshape(-1)

    return h.map(one)


def inverse(h: Column) -> Column:
    """The inverse of a 3x3 transform as column arithmetic; null if it has none."""

    def of(m: Column) -> Column:
        minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
        places = [(4, 5, 7, 8), (2, 1, 8, 7), (1, 2, 4, 5), (5, 3, 8, 6), (0, 2, 6, 8), (2, 0, 5, 3), (3, 4, 6, 7), (1, 0, 7, 6), (0, 1, 3, 4)]
        cofactors = F.array(*[minor(*p) for p in places])
        whole = lambda c: let(m[0] * c[0] + m[1] * c[3] + m[2] * c[6], lambda det: F.when(F.abs(det) >= 1e-12, F.transform(c, lambda x: x / det)))
        return let(cofactors, whole)

    return let(h, of)


def round_trip_error(h: Column, points: Column) -> Column:
    """The greatest distance between points and what there and back makes of them; 0 without points, null where one has no image."""

    def of(m: Column) -> Column:
        def error(p: Column) -> Column:
            there = project(m["h"], p["x"], p["y"])
            return let(let(there, lambda t: project(m["back"], t["x"], t["y"])), lambda home: F.hypot(home["x"] - p["x"], home["y"] - p["y"]))

        return let(F.transform(points, error), lambda e: F.when(F.size(e) == 0, 0.0).when(~F.exists(e, lambda x: x.isNull()), F.array_max(e)))

    return let(F.struct(h.alias("h"), inverse(h).alias("back")), of)


def subdivided(h: Column, polygon: Column, tolerance: float = 1.0, most: int = 12) -> Column:
    """A polygon's image under a transform, with so many points to an edge that no chord is off by more than the tolerance at its middle.

    An edge is halved all along until it fits, up to 2**most parts; null where one doesn't converge.
    """
    n = F.size(polygon)

    def edge(i: Column) -> Column:
        ends = F.struct(polygon[i].alias("a"), polygon[(i + 1) % n].alias("b"), h.alias("h"))

        def image(e: Column) -> Column:
            def at(t: Column) -> Column:
                place = F.struct((e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * t).alias("x"), (e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t).alias("y"))
                return let(place, lambda p: project(e["h"], p["x"], p["y"]))

            def off(parts: Column) -> Column:
                """How far the middles of so many parts are from their chords; infinite where a point has no image."""
                spots = F.transform(F.sequence(F.lit(0), parts * 2), lambda k: at(k / (parts * 2)))
                middle = lambda s: F.transform(F.sequence(F.lit(1), parts * 2 - 1, F.lit(2)), lambda k: F.hypot(s[k]["x"] - (s[k - 1]["x"] + s[k + 1]["x"]) / 2, s[k]["y"] - (s[k - 1]["y"] + s[k + 1]["y"]) / 2))
                return let(spots, lambda s: F.when(F.exists(s, lambda p: p.isNull()), float("inf")).otherwise(F.array_max(middle(s))))

            sizes = F.array(*[F.lit(1 << d) for d in range(most + 1)])
            fits = F.aggregate(sizes, F.lit(0), lambda done, parts: F.when(done > 0, done).when(off(parts) <= tolerance, parts).otherwise(0))
            return let(fits, lambda parts: F.when(parts > 0, F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda k: at(k / parts))))

        return let(ends, image)

    edges = F.transform(F.sequence(F.lit(0), n - 1), edge)
    return let(edges, lambda e: F.when((n >= 3) & ~F.exists(e, lambda x: x.isNull()), F.flatten(e)))
