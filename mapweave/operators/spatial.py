"""Joins of points and boxes with the extents of layers, and of boxes with each other.

A grid cuts the world into cells: extents are listed under every cell they touch, points under their own, boxes under all of
theirs, so candidates meet by an equal-key join, and only then are they tested; no plan compares every pair. Two boxes that
share several cells are kept in the first common one only. Pairs may be many times their sources: they are made where they
are used, and neither sorted nor sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import boxes
from mapweave.functions.boxes import Box

#: Degrees to a grid cell.
CELL = 2.0


def _key(lng: Column, lat: Column, cell: float) -> tuple[Column, Column]:
    return F.floor(lng / cell).cast("int"), F.floor(lat / cell).cast("int")


def _cells(b: Box, cell: float) -> Column:
    """Cells that a box touches; those across the antimeridian are two boxes, up to 180 and from -180 on."""
    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))

    inside = lambda v, limit: F.greatest(F.least(v, F.lit(limit)), F.lit(-limit))
    across = F.array_union(span(inside(b.w, 180.0), F.lit(180.0)), span(F.lit(-180.0), inside(b.e, 180.0)))
    columns = F.when(b.w <= b.e, span(inside(b.w, 180.0), F.greatest(inside(b.w, 180.0), inside(b.e, 180.0)))).otherwise(across)
    rows = F.when(b.s <= b.n, span(inside(b.s, 90.0), inside(b.n, 90.0))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _spans(b: Box, cell: float) -> Column:
    """Cells of a box as plain numbers: what overlaps by comparing numbers shares one."""
    x, y = [F.greatest(F.least(v, F.lit(180.0)), F.lit(-180.0)) for v in (b.w, b.e)], [F.greatest(F.least(v, F.lit(90.0)), F.lit(-90.0)) for v in (b.s, b.n)]
    span = lambda v: F.sequence(F.floor(F.least(*v) / cell).cast("int"), F.floor(F.greatest(*v) / cell).cast("int"))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _boxes(layers: DataFrame, cell: float, cells=_cells) -> DataFrame:
    """Layers, a row for each extent (__box) and cell that it touches; __earlier: the layer's extents before it, null if there are none."""
    before = F.when(F.col("__at") > 0, F.slice("extents", F.lit(1), F.col("__at")))
    rows = layers.select("*", F.posexplode("extents").alias("__at", "__box")).withColumn("__earlier", before)
    return rows.withColumn("__c", F.explode(cells(Box.of("__box"), cell))).select("*", "__c.cx", "__c.cy").drop("__c", "__at")


#: Rows of a cell that go to one task; where there are more, they are dealt out and what is listed there goes to each task.
PER_SLOT = 100_000


def meet(rows: DataFrame, listed: DataFrame, how: str = "inner", per_slot: int = PER_SLOT) -> DataFrame:
    """rows with what is listed under their cell; both have cx and cy, which go.

    Both are dealt out by cell into a fixed number of partitions: the pairs are many where the rows are few, so the number must
    not follow from the size of either side.
    """
    at, parts = ["cx", "cy"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = rows.groupBy(*at).agg(F.ceil(F.count("*") / per_slot).cast("int").alias("__slots")).filter("__slots > 1").withColumnsRenamed({"cx": "__x", "cy": "__y"})
    there = lambda side: side.join(F.broadcast(hot), F.col("cx").eqNullSafe(F.col("__x")) & F.col("cy").eqNullSafe(F.col("__y")), "left").drop("__x", "__y")
    slots, hashed = F.coalesce("__slots", F.lit(1)), [c for c, t in rows.dtypes if "map<" not in t]
    left = there(rows).withColumn("__slot", F.pmod(F.xxhash64(*hashed), slots).cast("int")).drop("__slots")
    right = there(listed).withColumn("__slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("__slots")
    keys = [*at, "__slot"]
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("shuffle_hash"), keys, how).drop(*keys)


def _once(rows: DataFrame, layers: DataFrame, key: str, cell: float, cells, test) -> DataFrame:
    """rows (with cx, cy) and layers of which an extent passes the test (of a box), each pair once.

    An extent counts only if none before it passes. First extents have none before, so they stay out of that test.
    """
    listed = _boxes(layers.filter(F.col(key).isNotNull()), cell, cells)
    first = meet(rows, listed.filter("__earlier IS NULL")).filter(test(Box.of("__box")))
    later = meet(rows, listed.filter("__earlier IS NOT NULL")).filter(test(Box.of("__box")))
    later = later.filter(~F.coalesce(F.exists("__earlier", lambda b: test(Box.of(b), False)), F.lit(False)))
    return first.union(later).drop("__box", "__earlier")


def lists(layers: DataFrame, order: list[str], columns: list[str], cell: float = CELL, top: list[str] | None = None) -> DataFrame:
    """A row a cell: `listed`, its extents as structs (order, columns, box, earlier) in this order. Filtered by `covers`, a layer is there once.

    With `top` (names of columns) only the first one that covers a point will be asked for, among any choice of values of these columns:
    behind an extent that holds the whole cell, those of equal values go. cell is a power of two then, so that its edges are exact.
    """
    b, c = Box.of("__box"), dict.fromkeys([*order, *columns])
    x, y = F.col("cx"), F.col("cy")
    inner = (x > F.floor(F.lit(-180.0 / cell))) & (x < F.floor(F.lit(180.0 / cell)))  # the outermost hold points beyond the world, too
    whole = (b.w <= b.e) & (b.w <= x * cell) & (b.e >= (x + 1) * cell) & (b.s <= y * cell) & (b.n >= (y + 1) * cell) & inner
    listed = _boxes(layers, cell)
    entry = F.struct(*c, F.col("__box").alias("box"), F.col("__earlier").alias("earlier"), F.coalesce(whole, F.lit(False)).alias("whole"))
    if top is None:
        return listed.groupBy("cx", "cy").agg(F.sort_array(F.collect_list(entry)).alias("listed"))
    some = listed.groupBy("cx", "cy", *[F.col(t).alias(f"__{t}") for t in top]).agg(F.sort_array(F.collect_list(entry)).alias("listed"))
    end = F.array_position(F.transform("listed", lambda e: e["whole"]), F.lit(True)).cast("int")
    some = some.withColumn("listed", F.when(end > 0, F.slice("listed", F.lit(1), end)).otherwise(F.col("listed")))
    return some.groupBy("cx", "cy").agg(F.sort_array(F.flatten(F.collect_list("listed"))).alias("listed"))


def listed_at(points: DataFrame, lists: DataFrame, cell: float = CELL) -> DataFrame:
    """points (lng, lat) with `listed` of their cell, null where nothing is."""
    cx, cy = _key(F.least(F.greatest("lng", F.lit(-180.0)), F.lit(180.0)), F.col("lat"), cell)
    return meet(points.withColumn("cx", cx).withColumn("cy", cy), lists, "left")


def covers(entry: Column) -> Column:
    """Whether an entry of `listed` covers the point, and none before it of the same layer does."""
    lng, lat = F.col("lng"), F.col("lat")
    before = F.when(entry["earlier"].isNotNull(), F.coalesce(boxes.any_contains(entry["earlier"], lng, lat), F.lit(False))).otherwise(F.lit(False))
    return Box.of(entry["box"]).contains(lng, lat) & ~before


def covering_plain(points: DataFrame, layers: DataFrame) -> DataFrame:
    """The same rows by comparing every pair: what tests hold the grid against."""
    return points.join(F.broadcast(layers), boxes.any_contains(F.col("extents"), F.col("lng"), F.col("lat")))


def covering_grid(points: DataFrame, layers: DataFrame, key: str = "id", cell: float = CELL) -> DataFrame:
    """Points with every layer that covers them (columns lng, lat and extents).

    A layer's row travels with its cells, so the pairs, which may be many times the points and the layers, are never moved.
    """
    cx, cy = _key(F.least(F.greatest("lng", F.lit(-180.0)), F.lit(180.0)), F.col("lat"), cell)
    return _once(points.withColumn("cx", cx).withColumn("cy", cy), layers, key, cell, _cells, lambda b, _=True: b.contains(F.col("lng"), F.col("lat")))


covering = covering_grid


def overlapping(areas: DataFrame, layers: DataFrame, area: str = "area", key: str = "id", cell: float = CELL) -> DataFrame:
    """Boxes with every layer that shares a point with them. Those that share several cells meet in the first common one only."""
    a = Box.of(area)
    rows = areas.withColumn("__c", F.explode(_spans(a, cell))).select("*", "__c.cx", "__c.cy", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy")).drop("__c")
    test = lambda b, here=True: b.overlaps(a) & _first_common(a, b, cell) if here else b.overlaps(a)
    return _once(rows, layers, key, cell, _spans, test).drop("__cx", "__cy")


def _first_common(p: Box, q: Box, cell: float, cx: str = "__cx", cy: str = "__cy") -> Column:
    """Whether the cell is the first one under which both boxes are listed by _spans."""
    first = lambda low, other, limit: F.floor(F.greatest(F.least(F.greatest(low, other), F.lit(limit)), F.lit(-limit)) / cell)
    return (F.col(cx) == first(F.least(p.w, p.e), F.least(q.w, q.e), 180.0)) & (F.col(cy) == first(F.least(p.s, p.n), F.least(q.s, q.n), 90.0))


def containing(areas: DataFrame, layers: DataFrame, area: str = "area", key: str = "id", cell: float = CELL) -> DataFrame:
    """Boxes with every layer of which one extent holds both corners: that extent is listed under the cell of the first one."""
    b = Box.of(area)
    cx, cy = _key(F.least(F.greatest(b.w, F.lit(-180.0)), F.lit(180.0)), b.s, cell)
    return _once(areas.withColumn("cx", cx).withColumn("cy", cy), layers, key, cell, _cells, lambda x, _=True: x.contains_box(b))


#: Boxes of a cell that go to one task when boxes are paired.
PAIRED = 2_000


def paired(rows: DataFrame, key: str, box: str, area: bool = False, cell: float = CELL, itself: bool = False) -> DataFrame:
    """Pairs of rows whose boxes share a point, or with `area` some area, the lesser key first: columns of the first as they are, of the second with `_b` behind their names."""
    a = rows.withColumn("__c", F.explode(_spans(Box.of(box), cell))).select("*", "__c.cx", "__c.cy", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy")).drop("__c")
    b = a.drop("__cx", "__cy").withColumnsRenamed({c: f"{c}_b" for c in rows.columns})
    p, q = Box.of(box), Box.of(f"{box}_b")
    wide = (F.least(p.e, q.e) > F.greatest(p.w, q.w)) & (F.least(p.n, q.n) > F.greatest(p.s, q.s)) if area else p.overlaps(q)
    order = F.col(key) <= F.col(f"{key}_b") if itself else F.col(key) < F.col(f"{key}_b")
    return meet(a, b, per_slot=PAIRED).filter(order & wide & _first_common(p, q, cell)).drop("__cx", "__cy")


def box_pairs(rows: DataFrame, key: str = "ord", box: str = "bbox", area: bool = False, cell: float = CELL) -> DataFrame:
    """Pairs (key_a, key_b) of rows, a before b, whose boxes share a point, or with `area` some area (touching edges don't count)."""
    return paired(rows.select(key, F.col(box).alias("__box")), key, "__box", area, cell).select(F.col(key).alias(f"{key}_a"), F.col(f"{key}_b"))
