"""Which country a point lies in, from outlines.

outlines: rows iso, shape (order of the shapes; the first one wins), ring (0: outer, then holes), points (array of structs
lng, lat). Pass one is strict containment by ray casting; what it misses takes the nearest outer ring within a tolerance.
Both passes meet outlines through a grid of cells, then compare boxes, then edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.boxes import Box
from mapweave.operators.spatial import CELL, _cells, _key

TOLERANCE_KM = 5.0


def _edges(points: Column) -> Column:
    """Each point with the one before it; the first with the last."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, F.lit(1), F.size(points) - 1))
    return F.zip_with(before, points, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_contains(points: Column, lng: Column, lat: Column) -> Column:
    """Even-odd rule."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when((b["lat"] > lat) != (a["lat"] > lat), lng < (a["lng"] - b["lng"]) * (lat - b["lat"]) / (a["lat"] - b["lat"]) + b["lng"]).otherwise(False)

    return F.aggregate(_edges(points), F.lit(False), lambda inside, e: inside != crosses(e))


def ring_distance_sq(points: Column, lng: Column, lat: Column, scale: Column) -> Column:
    """Least squared distance to an edge, in degrees of latitude."""
    def one(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy, wx, wy = (b["lng"] - a["lng"]) * scale, b["lat"] - a["lat"], (lng - a["lng"]) * scale, lat - a["lat"]
        long = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(long > 0, (wx * dx + wy * dy) / long).otherwise(0.0)))
        return (wx - t * dx) * (wx - t * dx) + (wy - t * dy) * (wy - t * dy)

    return F.array_min(F.transform(_edges(points), one))


def shapes(outlines: DataFrame) -> DataFrame:
    """A row a shape: iso, shape, outer, holes, box."""
    rings = F.sort_array(F.collect_list(F.struct("ring", "points")))
    s = outlines.groupBy("shape").agg(F.first("iso").alias("iso"), rings.alias("rings"))
    s = s.select("iso", "shape", F.get("rings", F.lit(0))["points"].alias("outer"), F.transform(F.slice("rings", F.lit(2), F.size("rings")), lambda r: r["points"]).alias("holes"))
    side = lambda f, c: f(F.transform("outer", lambda p: p[c]))
    box = Box(side(F.array_min, "lng"), side(F.array_min, "lat"), side(F.array_max, "lng"), side(F.array_max, "lat"))
    return s.withColumn("box", box.struct())


def _met(points: DataFrame, of: DataFrame, by: list[str], margin: float) -> DataFrame:
    """Points with the shapes whose box, grown by the margin, they lie in. Only boxes travel with the cells; the rings join the pairs that are left."""
    near = Box.of("box").grown(margin) if margin else Box.of("box")
    listed = of.select("shape", "box", F.explode(_cells(near, CELL)).alias("c")).select("shape", "box", "c.cx", "c.cy")
    cx, cy = _key(F.col("lng"), F.col("lat"), CELL)
    b = Box.of("box")
    inside = F.col("lng").between(b.w - margin, b.e + margin) & F.col("lat").between(b.s - margin, b.n + margin)
    pairs = points.select(*by, "lng", "lat", cx.alias("cx"), cy.alias("cy")).join(listed, ["cx", "cy"]).filter(inside)
    return pairs.drop("cx", "cy", "box").join(of.drop("box"), "shape")


def country_at(points: DataFrame, outlines: DataFrame, by: list[str], tolerance_km: float = TOLERANCE_KM) -> DataFrame:
    """points (lng, lat) with the column country; null where there is none. One pass tests containment and distance."""
    lng, lat, reach = F.col("lng"), F.col("lat"), max(tolerance_km, 0) / 111
    inside = ring_contains(F.col("outer"), lng, lat) & ~F.exists("holes", lambda h: ring_contains(h, lng, lat))
    met = _met(points, shapes(outlines), by, reach).withColumn("inside", inside)
    distance = ring_distance_sq(F.col("outer"), lng, lat, F.cos(F.radians(lat))) if reach else F.lit(None).cast("double")
    told = met.select(*by, "inside", "shape", "iso", F.when(~F.col("inside"), distance).alias("d"))
    near = F.when(F.col("d") <= reach * reach, F.struct("d", "shape"))
    best = told.groupBy(*by).agg(F.min_by("iso", F.when(F.col("inside"), F.col("shape"))).alias("strict"), F.min_by("iso", near).alias("near"))
    return points.join(best.select(*by, F.coalesce("strict", "near").alias("country")), by, "left")


def is_in_country(points: DataFrame, outlines: DataFrame, by: list[str], iso: str, tolerance_km: float = TOLERANCE_KM) -> DataFrame:
    return country_at(points, outlines, by, tolerance_km).withColumn("inside", F.coalesce(F.col("country") == iso, F.lit(False)))


def bounded_countries(outlines: DataFrame) -> DataFrame:
    return outlines.select("iso").distinct()
