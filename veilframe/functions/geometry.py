"""Rectangles, polygons, rasters and transforms as Column expressions; the cells of rasters come from :mod:`veilframe.functions.rasters`.

A rectangle is four columns; a polygon an array of [x, y]; a transform an array of nine doubles, row by row. Results that
a strict caller would refuse (a transform that cannot be inverted, an unsafe point) are null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import rasters

SINGULAR = 1e-12
GRID = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


class Rect(NamedTuple):
    """Left, top, right and bottom."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @staticmethod
    def of(prefix: str = "") -> Rect:
        """The columns <prefix>left, <prefix>top, <prefix>right and <prefix>bottom."""
        return Rect(*(F.col(f"{prefix}{side}") for side in Rect._fields))

    def struct(self) -> Column:
        """One struct column."""
        return F.struct(*(c.alias(n) for n, c in zip(self._fields, self)))

    @staticmethod
    def from_struct(c: Column) -> Rect:
        """The parts of a struct column."""
        return Rect(*(c[n] for n in Rect._fields))


def clamp(x: Column) -> Column:
    """Cut to [0, 1]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalized_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A pixel box as a clamped polygon of four corners whose right is not left of its left."""
    left, top = clamp(x / width), clamp(y / height)
    right, bottom = F.greatest(left, clamp((x + w) / width)), F.greatest(top, clamp((y + h) / height))
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))


def area(a: Rect) -> Column:
    """Width times height."""
    return (a.right - a.left) * (a.bottom - a.top)


def intersection_area(a: Rect, b: Rect) -> Column:
    """The area that both cover."""
    w = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.left, b.left))
    h = F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top))
    return w * h


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 where the union is empty, as integer boxes can be."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def center_distance(a: Rect, b: Rect) -> Column:
    """Between the centers."""
    return F.hypot((a.left + a.right) / 2 - (b.left + b.right) / 2, (a.top + a.bottom) / 2 - (b.top + b.bottom) / 2)


def scale_ratio(a: Rect, b: Rect) -> Column:
    """The largest ratio of two sides."""
    w, h = (a.right - a.left) / (b.right - b.left), (a.bottom - a.top) / (b.bottom - b.top)
    return F.greatest(w, 1 / w, h, 1 / h)


def expand(a: Rect, share: float) -> Rect:
    """Each side moved out by a share of the own width or height, inside [0, 1]."""
    w, h = (a.right - a.left) * share, (a.bottom - a.top) * share
    return Rect(clamp(a.left - w), clamp(a.top - h), clamp(a.right + w), clamp(a.bottom + h))


def strengthen(action: Column) -> Column:
    """A blur becomes a mosaic; other actions stay."""
    return F.when(action == "BLUR", "MOSAIC").otherwise(action)


def overlaps(a: Rect, b: Rect) -> Column:
    """Closed rectangles meet; touching counts."""
    return (a.left <= b.right) & (a.right >= b.left) & (a.top <= b.bottom) & (a.bottom >= b.top)


def union(a: Rect, b: Rect) -> Rect:
    """The smallest rectangle around both."""
    return Rect(F.least(a.left, b.left), F.least(a.top, b.top), F.greatest(a.right, b.right), F.greatest(a.bottom, b.bottom))


def contains_point(a: Rect, x: Column, y: Column) -> Column:
    """Edges count as inside."""
    return x.between(a.left, a.right) & y.between(a.top, a.bottom)


def contains_rect(outer: Rect, inner: Rect) -> Column:
    """The inner one lies in the outer one; shared edges count."""
    return (outer.left <= inner.left) & (outer.top <= inner.top) & (outer.right >= inner.right) & (outer.bottom >= inner.bottom)


def corners(a: Rect) -> Column:
    """The polygon of the four corners."""
    return F.array(F.array(a.left, a.top), F.array(a.right, a.top), F.array(a.right, a.bottom), F.array(a.left, a.bottom))


def polygon_box(poly: Column) -> Column:
    """:func:`polygon_bounds` as a struct in which each side is worked out once."""
    side = lambda i: F.transform(poly, lambda p: p[i])
    return let(side(0), lambda xs: let(side(1), lambda ys: Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).struct()))


def polygon_bounds(poly: Column) -> Rect:
    """The smallest rectangle around a polygon."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _edges(poly: Column) -> Column:
    """(from, to) of every edge, the closing one included."""
    return F.zip_with(poly, F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def polygon_area(poly: Column) -> Column:
    """The shoelace formula."""
    following = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    return F.abs(_sum(F.zip_with(poly, following, lambda a, b: a[0] * b[1] - b[0] * a[1]))) / 2


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def is_simple(poly: Column) -> Column:
    """At least three different vertices, an area above 1e-12, and no two edges that are not neighbours cross."""

    def crossing(edges: Column) -> Column:
        n = F.size(edges)

        def meets(e: Column, i: Column) -> Column:
            def other(f: Column, j: Column) -> Column:
                apart = (j > i + 1) & ~((i == 0) & (j == n - 1))
                d1, d2 = _cross(e["a"], e["b"], f["a"]), _cross(e["a"], e["b"], f["b"])
                d3, d4 = _cross(f["a"], f["b"], e["a"]), _cross(f["a"], f["b"], e["b"])
                return apart & (d1 * d2 < 0) & (d3 * d4 < 0)

            return F.exists(F.transform(edges, lambda f, j: other(f, j)), lambda x: x)

        return F.exists(F.transform(edges, meets), lambda x: x)

    return (F.size(F.array_distinct(poly)) == F.size(poly)) & (F.size(poly) >= 3) & (polygon_area(poly) > 1e-12) & ~let(_edges(poly), crossing)


def _inside(x: Column, y: Column, edges: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b[0] - a[0]) * (y - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]
        return ((a[1] > y) != (b[1] > y)) & (x < at)

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))


def point_in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule; a crossing counts if it lies strictly right of the point."""
    return _inside(x, y, let(poly, _edges))


def _cast(poly: Column) -> Column:
    return poly.cast("array<array<double>>")


def _once(make: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A function of whole batches that is not worked out again for each condition on what it gives, as the optimizer would."""
    return F.arrow_udf(make, kind).asNondeterministic()


def cells(poly: Column, grid: int = GRID) -> Column:
    """Ids, row by row, of the grid's cells whose centers a polygon holds; none for a null polygon."""
    return F.arrow_udf(lambda p: rasters.cells(p, grid), "array<int>")(_cast(poly))


def bit_rows(poly: Column, grid: int = GRID) -> Column:
    """The cells of :func:`cells` as rows of bits, an array of (y, words): bit x of a row's 64-bit words stands for its cell x. Rows without cells are left out."""
    return F.arrow_udf(lambda p: rasters.bit_rows(p, grid), "array<struct<y:int,words:array<bigint>>>")(_cast(poly))


def mask(poly: Column, grid: int = GRID) -> Column:
    """The cells of :func:`cells` as (top, bottom, words): the words of the rows from the first with a cell to the last; null without cells."""
    return _once(lambda p: rasters.masks(p, grid), rasters.MASK)(_cast(poly))


def shared_cells(a: Column, b: Column, grid: int = GRID) -> Column:
    """What two masks have in common, as (n, top, words); neither may be null."""
    both = _once(lambda at, aw, bt, bw: rasters.shared((at, aw), (bt, bw), grid), rasters.SHARED)
    return both(a["top"], a["words"], b["top"], b["words"])


def cell_count(poly: Column, grid: int = GRID) -> Column:
    """How many of the grid's cells a polygon holds."""
    return _once(lambda p: rasters.cell_counts(p, grid), "bigint")(_cast(poly))


def determinant(m: Column) -> Column:
    """Of a three by three matrix."""
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """The inverse, or null where the determinant is next to nothing."""

    def by(d: Column) -> Column:
        minor = lambda i, j, k, n: m[i] * m[j] - m[k] * m[n]
        parts = [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]
        return F.when(F.abs(d) >= SINGULAR, F.array(*(p * (1 / d) for p in parts)))

    return let(determinant(m), by)


def multiply(a: Column, b: Column) -> Column:
    """The matrix product."""
    return F.array(*(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)))


def map_point(m: Column, x: Column, y: Column, least: float = SINGULAR) -> Column:
    """[x, y] mapped, or null where the divisor is next to nothing."""
    return let(m[6] * x + m[7] * y + m[8], lambda d: F.when(F.abs(d) >= least, F.array((m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d)))


def map_rect(m: Column, a: Rect, least: float = SINGULAR) -> Column:
    """The bounds, inside [0, 1], of a rectangle's mapped corners, as a struct; null if unsafe or empty."""
    points = F.array(*(map_point(m, x, y, least) for x, y in ((a.left, a.top), (a.right, a.top), (a.right, a.bottom), (a.left, a.bottom))))

    def around(p: Column) -> Column:
        b = polygon_bounds(p)
        r = Rect(*map(clamp, b))
        return F.when(~F.exists(p, lambda q: q.isNull()) & (r.left < r.right) & (r.top < r.bottom), r.struct())

    return let(points, around)


#: Quarter turns and the horizontal mirror of the unit square.
TURNS = {0: (1, 0, 0, 0, 1, 0, 0, 0, 1), 90: (0, -1, 1, 1, 0, 0, 0, 0, 1), 180: (-1, 0, 1, 0, -1, 1, 0, 0, 1), 270: (0, 1, 0, -1, 0, 1, 0, 0, 1)}
MIRROR = (-1, 0, 1, 0, 1, 0, 0, 0, 1)


def _constant(values: tuple[int, ...]) -> Column:
    return F.lit([float(v) for v in values])


def output_transform(crop: Rect, degrees: Column, mirrored: Column) -> Column:
    """Buffer to output: crop, then turn, then mirror; null for a turn that is not a quarter."""
    w, h = crop.right - crop.left, crop.bottom - crop.top
    zero, one = F.lit(0.0), F.lit(1.0)
    cropped = F.array(1 / w, zero, -crop.left / w, zero, 1 / h, -crop.top / h, zero, zero, one)
    turn = F.lit(None)
    for angle, values in TURNS.items():
        turn = F.when(degrees == angle, _constant(values)).otherwise(turn)
    return let(multiply(turn, cropped), lambda m: F.when(mirrored, multiply(_constant(MIRROR), m)).otherwise(m))


def map_within(m: Column, x: Column, y: Column, tolerance: float = 1e-9) -> Column:
    """A mapped point of the unit square, cut to it; null if it lies outside by more than the tolerance."""
    inside = lambda v: v.between(-tolerance, 1 + tolerance)
    return let(map_point(m, x, y), lambda p: F.when(inside(p[0]) & inside(p[1]), F.array(clamp(p[0]), clamp(p[1]))))


def normalized_matrix(m: Column, left: Column, top: Column, width: Column, height: Column, buffer_width: Column, buffer_height: Column) -> Column:
    """A pixel matrix from the sensor's active area to a buffer, between unit squares."""
    row = lambda i, size: [m[i] * width / size, m[i + 1] * height / size, (m[i] * left + m[i + 1] * top + m[i + 2]) / size]
    return F.array(*row(0, buffer_width), *row(3, buffer_height), *row(6, F.lit(1.0)))


def to_buffer(a: Rect, width: Column, height: Column, degrees: Column) -> Column:
    """An upright pixel rectangle in the buffer's own orientation, as a struct."""
    turned = {
        0: a,
        90: Rect(a.top, height - a.right, a.bottom, height - a.left),
        180: Rect(width - a.right, height - a.bottom, width - a.left, height - a.top),
        270: Rect(width - a.bottom, a.left, width - a.top, a.right),
    }
    out = F.lit(None)
    for angle, r in turned.items():
        out = F.when(degrees == angle, r.struct()).otherwise(out)
    return out


def code_polygon(poly: Column, is_qr: Column) -> Column:
    """A code's polygon padded by a quarter (QR) or a fifth of its span per side; as it is where it has no area."""

    share = F.when(is_qr, 0.25).otherwise(0.20)

    def padded(box: Column) -> Column:
        b = Rect.from_struct(box)
        w, h = (b.right - b.left) * share, (b.bottom - b.top) * share
        return let(Rect(clamp(b.left - w), clamp(b.top - h), clamp(b.right + w), clamp(b.bottom + h)).struct(), lambda out: corners(Rect.from_struct(out)))

    return let(poly, lambda p: F.when((F.size(p) < 3) | (polygon_area(p) < 1e-9), p).otherwise(let(polygon_box(p), padded)))


def code_bounds(poly: Column, m: Column, least_side: float = 0.02) -> Column:
    """Bounds of a code mapped back through a transform, at least ``least_side`` wide and high; the whole frame where it has no area."""

    def around(box: Column) -> Column:
        b = Rect.from_struct(box)

        def widened(low: Column, high: Column) -> tuple[Column, Column]:
            mid, thin = (low + high) / 2, (high - low) < least_side
            return F.when(thin, clamp(mid - least_side / 2)).otherwise(low), F.when(thin, clamp(mid + least_side / 2)).otherwise(high)

        (left, right), (top, bottom) = widened(b.left, b.right), widened(b.top, b.bottom)
        return Rect(left, top, right, bottom).struct()

    whole = Rect(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0))).struct()
    mapped = lambda p: let(inverse(m), lambda back: F.transform(p, lambda q: map_point(back, q[0], q[1])))
    clamped = lambda points: let(polygon_box(points), lambda b: Rect(*map(clamp, Rect.from_struct(b))).struct())
    return let(poly, lambda p: F.when((F.size(p) < 3) | (polygon_area(p) < 1e-9), whole).otherwise(let(let(mapped(p), clamped), around)))


def unclipped(cx: Column, cy: Column, w: Column, h: Column, degrees: Column, ratio: float) -> Column:
    """The corners of a turned box grown by area * ratio / perimeter on every side."""
    grow = w * h * ratio / (2 * (w + h))
    hw, hh, c, s = w / 2 + grow, h / 2 + grow, F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.array(*(F.array(cx + x * hw * c - y * hh * s, cy + x * hw * s + y * hh * c) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def source_bounds(poly: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A polygon's bounds in source pixels, rounded outward, as a struct; null if empty."""
    b, sx, sy = polygon_bounds(poly), to_w / from_w, to_h / from_h
    zero = F.lit(0).cast("bigint")
    r = Rect(F.greatest(zero, F.floor(b.left * sx)), F.greatest(zero, F.floor(b.top * sy)), F.least(to_w.cast("bigint"), F.ceil(b.right * sx)), F.least(to_h.cast("bigint"), F.ceil(b.bottom * sy)))
    return F.when((F.size(poly) >= 3) & (r.right > r.left) & (r.bottom > r.top), r.struct())


def fit_within(w: Column, h: Column, edge: int) -> Column:
    """A size scaled down to a longest edge: rounded half up, at least 1."""
    scale = F.least(F.lit(1.0), edge / F.greatest(w, h))
    side = lambda v: F.greatest(F.lit(1).cast("bigint"), F.floor(v * scale + 0.5))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def fitted_dimensions(w: Column, h: Column, edge: int) -> Column:
    """A size scaled to a longest edge, in whole multiples of 32, at least 32."""
    scale = F.lit(float(edge)) / F.greatest(w, h)
    side = lambda v: F.greatest(F.lit(32).cast("bigint"), F.floor(v * scale / 32) * 32)
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def predicted(a: Rect, vx: Column, vy: Column, vw: Column, vh: Column, elapsed: Column) -> Rect:
    """Linear motion of the center; sizes never shrink; the result stays inside the frame with sides of at least 1e-6."""
    w0, h0 = a.right - a.left, a.bottom - a.top
    w = F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.greatest(w0, w0 + vw * elapsed)))
    h = F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.greatest(h0, h0 + vh * elapsed)))
    left = F.greatest(F.lit(0.0), F.least(1 - w, (a.left + a.right) / 2 + vx * elapsed - w / 2))
    top = F.greatest(F.lit(0.0), F.least(1 - h, (a.top + a.bottom) / 2 + vy * elapsed - h / 2))
    return Rect(left, top, left + w, top + h)


def usable_zone(a: Rect) -> Column:
    """An area of at least a ten-thousandth."""
    return area(a) >= 0.0001
