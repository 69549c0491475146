"""Bounding boxes as columns: structs of min_lng, min_lat, max_lng, max_lat in degrees.

Containment includes the edges and understands boxes across the antimeridian (min_lng > max_lng); overlap, centre, growth
and clamping compare plain numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.schema import WORLD

KM_PER_DEGREE = 111.32


@dataclass
class Box:
    w: Column
    s: Column
    e: Column
    n: Column

    @staticmethod
    def of(column: Column | str) -> Box:
        c = F.col(column) if isinstance(column, str) else column
        return Box(c["min_lng"], c["min_lat"], c["max_lng"], c["max_lat"])

    @staticmethod
    def at(values: tuple[float, float, float, float]) -> Box:
        return Box(*(F.lit(float(v)) for v in values))

    @staticmethod
    def from_array(a: Column) -> Box:
        return Box(*(F.get(a, F.lit(i)) for i in range(4)))

    def struct(self) -> Column:
        return F.struct(self.w.alias("min_lng"), self.s.alias("min_lat"), self.e.alias("max_lng"), self.n.alias("max_lat"))

    def array(self) -> Column:
        return F.array(self.w, self.s, self.e, self.n)

    def contains(self, lng: Column, lat: Column) -> Column:
        across = (lng >= self.w) | (lng <= self.e)
        return (lat >= self.s) & (lat <= self.n) & F.when(self.w <= self.e, (lng >= self.w) & (lng <= self.e)).otherwise(across)

    def contains_box(self, inner: Box) -> Column:
        """Both corners inside; nothing in between is tested."""
        return self.contains(inner.w, inner.s) & self.contains(inner.e, inner.n)

    def overlaps(self, other: Box) -> Column:
        return (self.s <= other.n) & (other.s <= self.n) & (self.w <= other.e) & (other.w <= self.e)

    def intersection(self, other: Box) -> Column:
        """The shared box, null if there is none."""
        shared = Box(F.greatest(self.w, other.w), F.greatest(self.s, other.s), F.least(self.e, other.e), F.least(self.n, other.n))
        return F.when(self.overlaps(other), shared.struct())

    def normalised(self) -> Box:
        """Corners in order, within the world."""
        return Box(
            F.greatest(F.lit(-180.0), F.least(self.w, self.e)), F.greatest(F.lit(-90.0), F.least(self.s, self.n)),
            F.least(F.lit(180.0), F.greatest(self.w, self.e)), F.least(F.lit(90.0), F.greatest(self.s, self.n)),
        )

    def center(self) -> tuple[Column, Column]:
        return (self.w + self.e) / 2, (self.s + self.n) / 2

    def width(self) -> Column:
        return F.when(self.w <= self.e, self.e - self.w).otherwise(360 - self.w + self.e)

    def height(self) -> Column:
        return self.n - self.s

    def area_km2(self) -> Column:
        return self.width() * KM_PER_DEGREE * F.cos(F.radians((self.s + self.n) / 2)) * self.height() * KM_PER_DEGREE

    def grown(self, margin: Column | float) -> Box:
        m = margin if isinstance(margin, Column) else F.lit(float(margin))
        return Box(self.w - m, self.s - m, self.e + m, self.n + m).normalised()

    def clamped(self, to: Box) -> Box:
        return Box(F.greatest(self.w, to.w), F.greatest(self.s, to.s), F.least(self.e, to.e), F.least(self.n, to.n))

    def polygon(self) -> Column:
        """GeoJSON of the ring."""
        ring = F.array(*[F.array(x, y) for x, y in ((self.w, self.s), (self.e, self.s), (self.e, self.n), (self.w, self.n), (self.w, self.s))])
        return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))

    def swapped(self, latitude_first: Column) -> Box:
        return Box(*(F.when(latitude_first, b).otherwise(a) for a, b in ((self.w, self.s), (self.s, self.w), (self.e, self.n), (self.n, self.e))))


def is_valid(a: Column) -> Column:
    """An array of four finite numbers that make a box of the world; min_lng > max_lng only across the antimeridian."""
    b = Box.from_array(a)
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = (b.w >= -180) & (b.e <= 180) & (b.s >= -90) & (b.n <= 90) & (b.s <= b.n) & ((b.w <= b.e) | (b.w > 0))
    return F.coalesce(a.isNotNull() & (F.size(a) == 4) & finite & inside, F.lit(False))


def union_of(box: Column | str) -> Column:
    """Aggregate: the smallest box around all; the world if there are none."""
    b = Box.of(box)
    parts = ((F.min, b.w), (F.min, b.s), (F.max, b.e), (F.max, b.n))
    return Box(*(F.coalesce(f(c), F.lit(v)) for (f, c), v in zip(parts, WORLD, strict=True))).struct()


def around(lng: Column, lat: Column) -> Column:
    """Aggregate: the smallest box around points; inverted infinities if there are none."""
    inf = float("inf")
    parts = ((F.min, lng, inf), (F.min, lat, inf), (F.max, lng, -inf), (F.max, lat, -inf))
    return Box(*(F.coalesce(f(c), F.lit(v)) for f, c, v in parts)).struct()


def extents(bbox: Column, coverage: Column) -> Column:
    return F.coalesce(coverage, F.array(bbox))


def total_area(boxes: Column) -> Column:
    return F.aggregate(boxes, F.lit(0.0), lambda total, b: total + Box.of(b).area_km2())


def any_contains(boxes: Column, lng: Column, lat: Column) -> Column:
    return F.exists(boxes, lambda b: Box.of(b).contains(lng, lat))


def any_contains_box(boxes: Column, inner: Box) -> Column:
    return F.exists(boxes, lambda b: Box.of(b).contains_box(inner))


def any_overlaps(boxes: Column, other: Box) -> Column:
    return F.exists(boxes, lambda b: Box.of(b).overlaps(other))
