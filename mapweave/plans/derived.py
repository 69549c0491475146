"""Layers, points, outlines and logs made from the driver's star-schema tables by whole-number arithmetic, so that SQL can make the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapweave.functions import boxes
from mapweave.functions.boxes import Box
from mapweave.functions.nuts import COUNTRIES
from mapweave.functions.services import is_tiled
from mapweave.schema import EU, LAYER

#: The layer that plays the fallback.
FALLBACK = "l.000005"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_codes() -> list[tuple[int, str, str]]:
    """(nation key, ISO code, NUTS code): the first nation plays the Union."""
    return [(0, EU, EU)] + [(i + 1, iso, nuts) for i, (nuts, iso, _) in enumerate(COUNTRIES[:24])]


def _codes(key: Column, column: int) -> Column:
    pairs = [F.lit(x) for row in nation_codes() for x in (row[0], row[column])]
    return F.element_at(F.create_map(*pairs), key.cast("int"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, country, lng, lat: a point a customer."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("pid"), _codes(F.col("c_nationkey"), 1).alias("country_here"), (c * 7919 % 70000 / 1000 - 25).alias("lng"), (c * 104729 % 38000 / 1000 + 34).alias("lat"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer a supplier, named after the part of the same key."""
    k = F.col("s_suppkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name", "p_type", "p_brand")
    rows = table(spark, sf_dir, "supplier").join(part, "s_suppkey", "left")
    w, s = k * 37 % 600 / 10 - 25, k * 53 % 330 / 10 + 34
    e, n = w + 2 + k % 9, s + 1 + k % 5
    third = (e - w) / 4
    halves = F.array(Box(w, s, w + third, n).struct(), Box(e - third, s, e, n).struct())
    iso, nuts = _codes(F.col("s_nationkey"), 1), _codes(F.col("s_nationkey"), 2)
    region = F.concat(nuts, (1 + k % 4).cast("string"), F.when(k % 2 == 1, (1 + k % 3).cast("string")).otherwise(F.lit("")))
    kind = F.when(k % 17 == 0, "WFS").when(k % 4 == 0, "WMTS").when(k % 4 == 1, "XYZ").otherwise("WMS")
    tags = F.filter(F.array(F.when(k % 13 == 0, "alternative"), F.when(k % 2 == 0, "rgb"), F.when(k % 3 == 0, "20cm")), lambda t: t.isNotNull())
    name, none = F.concat(F.lit("layer_"), k.cast("string")), F.array().cast("array<string>")
    url = F.concat(F.lit("https://maps.example/"), F.lower("s_name"), F.when(k % 3 == 0, "?").when(k % 3 == 1, "?map=x y").otherwise(""))
    url = F.regexp_replace(url, "#", "-")
    crs = F.when(k % 5 == 0, F.array(F.lit("EPSG:4326"), F.lit("EPSG:25832"))).otherwise(F.array(F.lit("CRS:84"), F.lit("EPSG:3857")))
    asks, version = k % 3 == 1, F.when(k % 2 == 0, "1.3.0").otherwise("1.1.1")
    wms = F.struct(F.array(name).alias("layers"), none.alias("styles"), F.lit("image/png").alias("format"), F.array(F.lit("text/plain"), F.lit("text/html")).alias("infoFormats"), crs.alias("crs"), version.alias("version"), asks.alias("queryable"), F.lit(True).alias("transparent"), F.lit(256).alias("tileSize"), F.lit(None).alias("time"), F.lit(None).alias("maxWidth"), F.lit(None).alias("maxHeight"), F.lit(None).alias("extraParams"))
    wmts = F.struct(name.alias("layer"), F.lit("grid").alias("tileMatrixSet"), F.lit("default").alias("style"), F.lit("image/jpeg").alias("format"), F.lit("1.0.0").alias("version"), F.lit("KVP").alias("requestEncoding"), F.lit(None).alias("urlTemplate"), F.lit("EPSG:3857").alias("crs"), F.lit(256).alias("tileSize"), F.lit(None).alias("tileMatrixTemplate"), F.lit(None).alias("dimensions"), asks.alias("queryable"), none.alias("infoFormats"))
    xyz = F.struct(F.concat(F.lit("https://{s}.tiles.example/"), name, F.lit("/{z}/{x}/{y}.png")).alias("urlTemplate"), F.when(k % 2 == 0, "tms").otherwise("xyz").alias("scheme"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("subdomains"), F.lit(256).alias("tileSize"), F.lit(None).alias("apiKeyParam"))
    wfs = F.struct(F.array(name).alias("typeNames"), F.lit("2.0.0").alias("version"), F.lit("application/json").alias("outputFormat"), F.lit("EPSG:4326").alias("crs"), F.lit(50).alias("maxFeatures"), F.lit(None).alias("extraParams"))
    service = F.struct(kind.alias("type"), url.alias("url"), *[F.when(kind == t.upper(), v).alias(t) for t, v in (("wms", wms), ("wmts", wmts), ("xyz", xyz), ("wfs", wfs))], F.lit(None).alias("cog"))
    terms = F.struct(F.when(k % 3 == 0, "CC-BY-4.0").when(k % 3 == 1, "custom").otherwise("unknown").alias("id"), F.when(k % 3 == 1, "Open licence").alias("name"), F.when(k % 6 == 0, "https://terms.example/by").alias("url"), F.lit(None).alias("notes"))
    made = {
        "id": F.concat(F.lit("l."), F.lpad(k.cast("string"), 6, "0")), "title": F.coalesce("p_name", F.lit("untitled")), "description": F.col("p_type"), "category": F.when(k % 5 == 0, "satellite").when(k % 5 == 4, "cadastre").otherwise("orthophoto"),
        "provider": F.struct(F.col("s_name").alias("name"), F.when(k % 2 == 0, "https://provider.example/").alias("url"), F.lit(None).alias("shortName")), "country": iso, "nuts": F.when((k % 7 != 0) & (iso != EU), region), "regionName": F.col("p_brand"),
        "bbox": Box(w, s, e, n).struct(), "coverage": F.when(k % 6 == 0, halves), "service": service, "license": terms, "attribution": F.concat(F.lit("Provider "), (k % 12).cast("string")), "minZoom": k % 8, "maxZoom": 14 + k % 9,
        "resolutionMeters": (1 + k % 7) / 10, "temporal": F.lit(None), "tags": tags, "status": F.when(k % 11 == 0, "experimental").otherwise("active"), "metadataUrl": F.lit(None), "documentationUrl": F.lit(None),
        "lastVerified": F.concat(F.lit("2026-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string")), "source_file": F.lit("supplier"), "scope": F.lit("EU"), "ord": k,
    }
    types = StructType.fromDDL(LAYER)  # parsed by the session
    out = rows.select(*[v.cast(types[c].dataType).alias(c) for c, v in made.items()])
    out = out.withColumn("extents", boxes.extents(F.col("bbox"), F.col("coverage"))).withColumn("is_tiled", is_tiled())
    return out.withColumn("area_km2", F.round(boxes.total_area(F.col("extents")), 6))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape a nation: a ring of eight points around a middle, with a square hole in every third."""
    k = F.col("n_nationkey")
    cx, cy, r = k * 37 % 60 - 20.0, k * 23 % 30 + 38.0, 2.0 + k % 4
    # An uneven ring of eight corners, in quarters of the radius.
    corners = [(4, 0), (3, 3), (0, 4), (-3, 2), (-4, 0), (-2, -3), (0, -4), (3, -2)]
    at = lambda size, pts: F.array(*[F.struct((cx + size * a / 4).alias("lng"), (cy + size * b / 4).alias("lat")) for a, b in pts])
    square = at(F.lit(1.0), [(-2, -2), (2, -2), (2, 2), (-2, 2)])
    rings = F.filter(F.array(F.struct(F.lit(0).alias("ring"), at(r, corners).alias("points")), F.when(k % 3 == 0, F.struct(F.lit(1).alias("ring"), square.alias("points")))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "nation").select(_codes(k, 1).alias("iso"), k.cast("long").alias("shape"), F.explode(rings).alias("r")).select("iso", "shape", "r.ring", "r.points")


def tile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile requests from events: seq, ts, layer_id, z, x, y, outcome."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"), "ts", F.concat(F.lit("l."), F.lpad((F.col("user_id") % 20).cast("string"), 6, "0")).alias("layer_id"), (12 + e % 4).cast("int").alias("z"),
        (2000 + e * 31 % 40).alias("x"), (1400 + e * 17 % 40).alias("y"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "blank").otherwise("served").alias("outcome"),
    )
