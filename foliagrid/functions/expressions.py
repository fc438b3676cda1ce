"""Predicates, assignments and geometry as columns, so that filters reach the scan and stay in generated code."""

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges up to which a polygon test is unrolled; larger polygons go through one array.
UNROLLED_EDGES = 64


def range_predicate(spec: str, names: dict[str, str] | None = None) -> Column:
    """``Dimension[low:high]``, both ends in, either may be missing; several by commas, all of which must hold."""
    parts = []
    for one in filter(None, (x.strip() for x in spec.split(","))):
        m = re.fullmatch(r"(\w+)\[([^:\]]*):([^\]]*)\]", one)
        if not m:
            raise ValueError(f"not a range: {one!r}")
        column = F.col((names or {}).get(m[1], m[1]))
        bounds = [column >= float(m[2])] if m[2].strip() else []
        bounds += [column <= float(m[3])] if m[3].strip() else []
        parts += bounds or [column.isNotNull()]
    if not parts:
        raise ValueError("an empty range")
    return reduce(lambda a, b: a & b, parts)


def boolean_expression(text: str, names: dict[str, str] | None = None) -> Column:
    """An expression with &&, || and ! over dimensions, as a column."""
    sql = re.sub(r"!(?!=)", " NOT ", text.replace("&&", " AND ").replace("||", " OR ")).replace("==", "=")
    for old, new in (names or {}).items():
        sql = re.sub(rf"\b{old}\b", f"`{new}`", sql)
    return F.expr(sql)


def assignments(values: str | list[str], names: dict[str, str] | None = None) -> dict[str, Column]:
    """``Name = expression`` (one or a list), or ``Name[low:high]=value`` that sets only rows in the range."""
    out: dict[str, Column] = {}
    for one in [values] if isinstance(values, str) else values:
        left, _, right = one.partition("=")
        m = re.fullmatch(r"\s*(\w+)\s*(\[[^\]]*\])?\s*", left)
        if not m or not right.strip():
            raise ValueError(f"not an assignment: {one!r}")
        name = (names or {}).get(m[1], m[1])
        value = boolean_expression(right.strip(), names)
        bounds = (m[2] or "[:]")[1:-1].strip()
        out[name] = value if bounds == ":" else F.when(range_predicate(f"{m[1]}[{bounds}]", names), value).otherwise(F.col(name))
    return out


def inside_rings(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over the edges of closed rings, behind a comparison with their box that can be pushed to a scan."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    if not edges:
        return F.lit(False)
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    if len(edges) <= UNROLLED_EDGES:
        crossing = [F.when((F.lit(a[1]) > y) != (F.lit(b[1]) > y), x < F.lit(b[0] - a[0]) * (y - F.lit(a[1])) / F.lit(b[1] - a[1]) + F.lit(a[0])).otherwise(False) for a, b in edges]
        odd = reduce(lambda p, q: p != q, crossing)
    else:
        table = F.array(*[F.struct(F.lit(a[0]).alias("x1"), F.lit(a[1]).alias("y1"), F.lit(b[0]).alias("x2"), F.lit(b[1]).alias("y2")) for a, b in edges])
        cross = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        odd = F.aggregate(table, F.lit(False), lambda acc, e: acc != cross(e))
    return box & odd


def clip_to_box(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring cut by an axis-parallel box (xmin, ymin, xmax, ymax), one side after another; empty if they don't meet."""
    out = list(ring)
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        source, out = out, []
        for a, b in zip(source, [*source[1:], *source[:1]], strict=True):
            ina, inb = (sign * (p[axis] - limit) >= 0 for p in (a, b))
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if inb:
                out.append(b)
    return out


def tile_number(name: Column, token: int, prefix: str = "uncompress_") -> Column:
    """Token `token` (from 0) of a file name's words between underscores, one further after the prefix; null if no number."""
    base = F.element_at(F.split(name, "/"), -1)
    words = F.split(F.regexp_replace(base, r"\.[^.]*$", ""), "_")
    at = F.when(base.startswith(prefix), token + 2).otherwise(token + 1)
    return F.try_element_at(words, at.cast("int")).try_cast("int")


#: The projection's fixed values: GRS80, two standard parallels, origin, false easting and northing (Lambert-93).
LAMBERT_93 = {"a": 6378137.0, "e": 0.0818191910428158, "lat1": 44.0, "lat2": 49.0, "lat0": 46.5, "lon0": 3.0, "x0": 700000.0, "y0": 6600000.0}


def lambert_xy(lon: Column, lat: Column, p: dict[str, float] = LAMBERT_93) -> tuple[Column, Column]:
    """Conformal conic coordinates of degrees, in closed form (Snyder 1987, 15-1 to 15-11)."""
    e, rad = p["e"], math.radians
    m = lambda v: math.cos(v) / math.sqrt(1 - (e * math.sin(v)) ** 2)
    t = lambda v: math.tan(math.pi / 4 - v / 2) / ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2)
    n = math.log(m(rad(p["lat1"])) / m(rad(p["lat2"]))) / math.log(t(rad(p["lat1"])) / t(rad(p["lat2"])))
    f = m(rad(p["lat1"])) / (n * t(rad(p["lat1"])) ** n)
    rho0 = p["a"] * f * t(rad(p["lat0"])) ** n
    v = F.radians(lat)
    s = F.lit(e) * F.sin(v)
    rho = F.lit(p["a"] * f) * F.pow(F.tan(F.lit(math.pi / 4) - v / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2)), F.lit(n))
    theta = F.lit(n) * (F.radians(lon) - F.lit(rad(p["lon0"])))
    return F.lit(p["x0"]) + rho * F.sin(theta), F.lit(p["y0"] + rho0) - rho * F.cos(theta)
