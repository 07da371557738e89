"""Points, lines and imaged rectangles in homogeneous coordinates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def homogeneous(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def box_baseline(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Left and right end of the lowest row of pixels: array x0, y, x1, y."""
    return F.array(x, y + h - 1, x + w - 1, y + h - 1)


def crossing(p: Column, d: Column, q: Column, e: Column, least: float = 1e-6) -> Column:
    """Where the line through p along d meets the one through q along e; null when they are parallel."""
    turn = d[0] * e[1] - d[1] * e[0]
    t = ((q[0] - p[0]) * e[1] - (q[1] - p[1]) * e[0]) / F.when(F.abs(turn) >= least, turn)
    return F.when(t.isNotNull(), F.array(p[0] + t * d[0], p[1] + t * d[1]))


def vanishing_line(point: Column, least: float = 1e-6) -> Column:
    """The level line through a vanishing point, or the line at infinity when the point lies there."""
    size = F.greatest(F.abs(point[0]), F.abs(point[1]), F.lit(1.0))
    far = F.abs(point[2]) < least * size
    return F.when(far, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(
        F.array(F.lit(0.0), F.lit(1.0), -point[1] / F.when(~far, point[2]))
    )


def rectification(line: Column) -> Column:
    """The matrix, row by row, that takes the line to infinity; its last entry is 1 where it can be."""
    unit = F.transform(line, lambda v: v / F.when(F.abs(line[2]) > 1e-12, line[2]).otherwise(F.lit(1.0)))
    return F.concat(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))), unit)


def aspect_and_focal(xs: Column, ys: Column, width: Column, height: Column, focal: Column | None = None) -> Column:
    """Width over height of a rectangle from its four imaged corners (clockwise from the top left), and the focal length.

    The corners are scaled so that opposite sides become equal vectors in space; right angles give the focal length
    (after Zhang and He 2002), with the principal point in the middle. struct aspect, focal: null where the picture
    doesn't determine them.
    """
    ratio = lambda a, b: a / F.when(F.abs(b) >= 1e-9, b)
    centred = F.array(*(homogeneous(xs[i] - width / 2, ys[i] - height / 2) for i in range(4)))

    def sides(c: Column) -> Column:
        tl, tr, br, bl = (c[i] for i in range(4))
        return F.array(tl, tr, bl, F.array(ratio(dot(cross(tl, br), bl), dot(cross(tr, br), bl)), ratio(dot(cross(tl, br), tr), dot(cross(bl, br), tr))))

    def vectors(c: Column) -> Column:
        return F.array(*(F.array(*(c[3][i - 1] * c[i][j] - c[0][j] for j in range(3))) for i in (1, 2)))

    def solved(c: Column) -> Column:
        u, v = c[0], c[1]
        square = -ratio(u[0] * v[0] + u[1] * v[1], u[2] * v[2])
        f = F.sqrt(F.when(square > 0, square)) if focal is None else focal.cast("double")
        return F.array(f, *((a[0] * a[0] + a[1] * a[1]) / (f * f) + a[2] * a[2] for a in (u, v)))

    found = bound(bound(bound(centred, sides), vectors), solved)
    return bound(found, lambda r: F.struct(F.when((r[1] > 0) & (r[2] > 0), F.sqrt(r[1] / r[2])).alias("aspect"), r[0].alias("focal")))


def tilt(dx: Column, dy: Column, least: float = 4.0) -> Column:
    """Degrees from the level, without sign; null for lines too short to have a stable one."""
    return F.when(F.abs(dx) >= least, F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))))


def median_tilt(dx: Column, dy: Column) -> Column:
    """Aggregate: the median tilt of lines, 0 without any."""
    return F.coalesce(F.median(tilt(dx, dy)), F.lit(0.0))


def outer_edge(x: Column, y: Column, slope: Column, sign: int, margin: float = 2.0, percent: float = 98.0) -> Column:
    """Aggregate: the x at y = 0 of an edge of the given dx/dy, moved outwards until it holds all but the last points."""
    share = percent / 100 if sign > 0 else 1 - percent / 100
    return F.percentile(x - slope * y, share) + F.lit(sign * margin)
