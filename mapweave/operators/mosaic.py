"""Planning the sources of map tiles from ordered candidates (see ranking.mosaic_order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import mercator
from mapweave.operators.ranking import TOP_CELL
from mapweave.operators.spatial import CELL, covers, listed_at, lists
from mapweave.schema import EU

#: Map zoom from which imagery is looked for; below it only the fallback is drawn. Zoom to which tiles are requested.
FROM_ZOOM, MAX_ZOOM = 15, 19


def tile_center(tile: int = 512) -> tuple[Column, Column]:
    b = mercator.tile_box(F.col("x"), F.col("y"), F.col("z"))
    return b.center()


def select(tiles: DataFrame, candidates: DataFrame, fallback: str | None, resolved: str | None = None, from_zoom: int = FROM_ZOOM, tile: int = 512) -> DataFrame:
    """tiles (z, x, y and, if resolved is named, the country at the centre) with rows nth, id and satellite_only.

    A tile is asked by its centre. The most local source names the country: sources of other countries go behind those of
    it and of the Union, and the fallback closes the list. Low zooms skip the join.
    """
    keys, none = ["z", "x", "y"], F.array().cast("array<string>")
    asked = _asked(tiles, from_zoom, tile)
    deep = _listed(asked, candidates, fallback).withColumn("hits", F.filter("listed", _usable)).drop("listed")
    is_of = lambda e, c: F.coalesce(e["country"] == c, F.lit(False))
    guess = F.get(F.filter("hits", lambda e: e["country"] != EU), F.lit(0))["country"]
    if resolved:
        named = F.when(F.col(resolved) != "", F.col(resolved))
        guess = F.when(named.isNull(), guess).otherwise(F.when(F.exists("hits", lambda e: is_of(e, named)), named))
    foreign = lambda e: F.coalesce((e["country"] != F.col("local")) & (e["country"] != EU), F.lit(False))
    part = lambda test: F.coalesce(F.transform(F.filter("hits", test), lambda e: e["id"]), none)
    last = F.array(F.lit(fallback)) if fallback else none
    chain = deep.withColumn("local", guess).select(*keys, F.concat(part(lambda e: ~foreign(e)), part(foreign), last).alias("chain"))
    rows = chain.unionByName(asked.filter("NOT __deep").select(*keys, last.alias("chain")))
    rows = rows.select(*keys, (F.size("chain") <= 1).alias("satellite_only"), F.posexplode_outer("chain").alias("at", "id")).filter("at IS NOT NULL")
    return rows.select(*keys, (F.col("at") + 1).alias("nth"), "id", "satellite_only")


def _asked(tiles: DataFrame, from_zoom: int, tile: int) -> DataFrame:
    """tiles with __zoom, the map's; __deep: whether imagery is looked for; lng, lat: their centre."""
    lng, lat = tile_center(tile)
    zoom = mercator.map_zoom(F.col("z"), tile)
    return tiles.withColumn("__zoom", zoom).withColumn("__deep", F.coalesce(F.col("__zoom") >= from_zoom, F.lit(False))).withColumn("lng", lng).withColumn("lat", lat)


def _listed(asked: DataFrame, candidates: DataFrame, fallback: str | None, cell: float = CELL, top: list[str] | None = None) -> DataFrame:
    """Deep tiles with the candidates listed at their centre."""
    return listed_at(asked.filter("__deep"), lists(candidates.filter(F.col("id") != (fallback or "")), ["mosaic_ord"], ["id", "minZoom", "country"], cell, top), cell)


def _usable(entry: Column) -> Column:
    return covers(entry) & (F.col("__zoom") >= entry["minZoom"])


def best_for(tiles: DataFrame, candidates: DataFrame, fallback: str | None, resolved: str | None = None, from_zoom: int = FROM_ZOOM, tile: int = 512) -> DataFrame:
    """The first source of each tile. Where no country is named, that is the first in the candidates' order: it names the country itself, or is the Union's."""
    if resolved:
        return select(tiles, candidates, fallback, resolved, from_zoom, tile).filter("nth = 1").select("z", "x", "y", "id")
    asked = _asked(tiles, from_zoom, tile)
    first = F.get(F.filter("listed", _usable), F.lit(0))["id"]
    best = _listed(asked, candidates, fallback, TOP_CELL, ["minZoom"]).select("z", "x", "y", F.coalesce(first, F.lit(fallback)).alias("id"))
    return best.unionByName(asked.filter("NOT __deep").select("z", "x", "y", F.lit(fallback).alias("id"))).filter("id IS NOT NULL")


def detail_zoom(points: DataFrame, candidates: DataFrame, layers: DataFrame, fallback: str | None, by: list[str], upscale: float = 1, low: int = 12, high: int = 22, empty_areas: DataFrame | None = None, tile: int = 512) -> DataFrame:
    """points with detail_zoom: the zoom to which their best source has detail; low where there is none.

    empty_areas: rows (id, area) of blank, unconfirmed ground at the areas' zoom, whose layers don't count there.
    """
    probe = max(0, high - (1 if tile == 512 else 0))
    x, y = mercator.tile_of(F.col("lng"), F.col("lat"), F.lit(probe))
    asked = points.withColumn("z", F.lit(probe)).withColumn("x", x).withColumn("y", y)
    tiles = asked.select("z", "x", "y").distinct()
    if empty_areas is None:
        best = best_for(tiles, candidates, fallback, tile=tile)
    else:
        chosen = select(tiles, candidates, fallback, tile=tile).withColumn("area", mercator.area_key(F.col("x"), F.col("y"), F.col("z")))
        best = chosen.join(empty_areas.select("id", "area"), ["id", "area"], "left_anti").groupBy("z", "x", "y").agg(F.min_by("id", "nth").alias("id"))
    numbers = layers.select("id", "resolutionMeters", F.col("maxZoom").alias("max_zoom"))
    found = asked.join(best, ["z", "x", "y"], "left").withColumn("id", F.coalesce("id", F.lit(fallback))).join(numbers, "id", "left")
    native = F.when(F.col("resolutionMeters") > 0, mercator.zoom_of_resolution_at(F.col("resolutionMeters"), F.col("lat"))).otherwise(F.col("max_zoom"))
    value = F.when(F.col("max_zoom").isNull(), F.lit(float(low))).otherwise(F.least(F.lit(float(high)), F.col("max_zoom").cast("double"), F.greatest(F.lit(float(low)), native + upscale)))
    return found.select(*by, F.col("id").alias("best"), value.alias("detail_zoom"))


def zoom_limit(detail: DataFrame, by: list[str]) -> DataFrame:
    """The deepest of several mosaics, to one digit."""
    return detail.groupBy(*by).agg((F.floor(F.max("detail_zoom") * 10 + 0.5) / 10).alias("limit"))


def limit_changes(limits: DataFrame, session: str, at: str) -> DataFrame:
    """Moves at which a limit is applied: the first, and those that differ from the last applied one by 0.05 at least.

    Limits have one digit, so a limit differs from the last applied one exactly if it differs from the one before it.
    """
    before = F.lag("limit").over(Window.partitionBy(session).orderBy(at))
    return limits.withColumn("before", before).filter(F.col("before").isNull() | (F.abs(F.col("limit") - F.col("before")) >= 0.05)).drop("before")


def prefetch_around(tiles: DataFrame, radius: int = 1) -> DataFrame:
    """tiles with the tiles around them (px, py): columns wrap, rows end."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    ring = tiles.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).filter("dx <> 0 OR dy <> 0")
    span = F.pow(F.lit(2.0), F.col("z")).cast("long")
    ring = ring.withColumn("px", F.pmod(F.col("x") + F.col("dx"), span)).withColumn("py", F.col("y") + F.col("dy"))
    return ring.filter((F.col("py") >= 0) & (F.col("py") < span)).drop("dx", "dy")


def prefetch_ahead(tiles: DataFrame, depth: int = 2) -> DataFrame:
    """tiles (z, x, y, heading_x, heading_y) with tiles in the direction of travel, three across; standing still gives the ring."""
    length = F.sqrt(F.col("heading_x") * F.col("heading_x") + F.col("heading_y") * F.col("heading_y"))
    still = F.coalesce(F.isnan(length) | (length < 1e-6) | (length == float("inf")), F.lit(True))
    up = lambda c: F.floor(c + 0.5)
    moving = tiles.filter(~still).withColumn("sx", F.col("heading_x") / length).withColumn("sy", F.col("heading_y") / length)
    moving = moving.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("across", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    tx = up(up(F.col("x") + F.col("sx") * F.col("step")) - F.col("sy") * F.col("across"))
    ty = up(up(F.col("y") + F.col("sy") * F.col("step")) + F.col("sx") * F.col("across"))
    span = F.pow(F.lit(2.0), F.col("z")).cast("long")
    ahead = moving.withColumn("tx", tx).withColumn("py", ty).filter((F.col("py") >= 0) & (F.col("py") < span)).withColumn("px", F.pmod(F.col("tx"), span))
    ahead = ahead.dropDuplicates([*tiles.columns, "tx", "py"]).select(*tiles.columns, "px", "py")
    return ahead.unionByName(prefetch_around(tiles.filter(still)).select(*tiles.columns, "px", "py"))


def headings(moves: DataFrame, session: str, at: str) -> DataFrame:
    """Direction of travel from one move of a session to the next, in tiles."""
    w = Window.partitionBy(session).orderBy(at)
    same = F.lag("z").over(w) == F.col("z")
    d = lambda c: F.when(same, F.col(c) - F.lag(c).over(w)).otherwise(0).cast("double")
    return moves.withColumn("heading_x", F.coalesce(d("x"), F.lit(0.0))).withColumn("heading_y", F.coalesce(d("y"), F.lit(0.0)))


def child_tiles(tiles: DataFrame) -> DataFrame:
    """The four tiles below each one: quadrant, cx, cy, cz."""
    q = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))])).alias("quadrant", "q")
    return tiles.select("*", q).select(*tiles.columns, "quadrant", (F.col("x") * 2 + F.col("q.a")).alias("cx"), (F.col("y") * 2 + F.col("q.b")).alias("cy"), (F.col("z") + 1).alias("cz"))


def mosaic_attribution(candidates: DataFrame, layers: DataFrame, fallback: str | None, html: bool = True) -> DataFrame:
    """One row: credits of all candidates in their order, then of the fallback."""
    from mapweave.functions.text import credits

    rows = candidates.withColumn("ord", F.col("mosaic_ord").cast("long")).drop("mosaic_ord")
    if fallback:
        rows = rows.unionByName(layers.filter(F.col("id") == fallback).withColumn("ord", F.lit(1 << 40)))
    return credits(rows, html=html)


def active_attribution(active: DataFrame, layers: DataFrame, fallback: str | None, html: bool = True) -> DataFrame:
    """One row: credits of the sources in use (layer_id, used_at), the latest first; of the fallback if there are none."""
    from mapweave.functions.text import credits

    used = layers.join(F.broadcast(active.select(F.col("layer_id").alias("id"), F.unix_micros(F.col("used_at").cast("timestamp")).alias("at"))), "id")
    now = credits(used.withColumn("ord", -F.col("at")), html=html)
    base = credits(layers.filter(F.col("id") == (fallback or "")), html=html).withColumnRenamed("attribution", "base")
    return now.join(base).select(F.when(F.col("attribution") != "", F.col("attribution")).otherwise(F.col("base")).alias("attribution"))


def walk(places: DataFrame, zooms: list[int], candidates: DataFrame, fallback: str | None, **options) -> DataFrame:
    """places (name, lng, lat) at each zoom: the tile there and the sources that would be tried, in order."""
    z = F.explode(F.array(*[F.lit(int(v)) for v in zooms]))
    at = places.select("name", "lng", "lat", z.alias("z"))
    x, y = mercator.tile_of(F.col("lng"), F.col("lat"), F.col("z"))
    at = at.withColumn("x", x).withColumn("y", y).select("name", "z", "x", "y")
    return at.join(select(at.select("z", "x", "y").distinct(), candidates, fallback, **options), ["z", "x", "y"])
