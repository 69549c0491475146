"""Layers as sources, layers and styles for three map libraries, as JSON columns; null where a service can't be drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import urls
from mapweave.functions.boxes import Box
from mapweave.functions.services import is_type, needs_reprojection
from mapweave.functions.text import credit
from mapweave.schema import MERCATOR_WORLD

#: The scheme of URLs that the host application resolves itself, and the prefix of names in style documents.
SCHEME, PREFIX = "mapweave", "mapweave"


def source_id() -> Column:
    return F.concat(F.lit(f"{PREFIX}-"), "id")


def layer_id() -> Column:
    return F.concat(F.lit(f"{PREFIX}-"), "id", F.lit("-raster"))


def own_template() -> Column:
    """For services that must be reprojected by the host."""
    return F.concat(F.lit(f"{SCHEME}://"), urls.encode_component(F.col("id")), F.lit("/{z}/{x}/{y}"))


def mosaic_template(mosaic: str) -> str:
    from urllib.parse import quote

    return f"{SCHEME}-mosaic://{quote(mosaic, safe='')}" + "/{z}/{x}/{y}"


def parse_own(url: Column) -> Column:
    """Struct of id, z, x and y of such a URL."""
    pattern = rf"^{SCHEME}(?:-mosaic)?://([^/]+)/(\d+)/(\d+)/(\d+)$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    return F.when(url.rlike(pattern), F.struct(F.url_decode(part(1)).alias("id"), *[part(i).cast("long").alias(n) for i, n in ((2, "z"), (3, "x"), (4, "y"))]))


def _tile_size(tile: int | None) -> Column:
    return F.lit(tile) if tile else F.coalesce("service.wms.tileSize", "service.wmts.tileSize", "service.xyz.tileSize", F.lit(256))


def _templates(proxy: str | None) -> Column:
    url, s = F.col("service.url"), F.col("service")
    wms = F.when(needs_reprojection(), own_template()).otherwise(urls.wms_template(url, s["wms"], proxy=proxy))
    return F.when(is_type("WMS"), F.array(wms)).when(is_type("WMTS"), F.array(urls.wmts_template(url, s["wmts"], proxy))).when(is_type("XYZ"), urls.xyz_templates(s["xyz"], proxy=proxy))


def raster_source(proxy: str | None = None, tile: int | None = None, html: bool = True) -> Column:
    bounds = Box.of("bbox").clamped(Box.at(MERCATOR_WORLD)).array()
    out = F.struct(
        F.lit("raster").alias("type"), bounds.alias("bounds"), F.col("minZoom").alias("minzoom"), F.col("maxZoom").alias("maxzoom"), _tile_size(tile).alias("tileSize"),
        credit(html).alias("attribution"), F.col("service.xyz.scheme").alias("scheme"), _templates(proxy).alias("tiles"),
    )
    return F.when(_templates(proxy).isNotNull(), out)


def raster_layer(opacity: float = 1.0, visible: Column | None = None, maxzoom: int | None = None, resampling: str | None = None) -> Column:
    shown = F.when(visible if visible is not None else F.lit(True), "visible").otherwise("none")
    paint = [F.lit(opacity).alias("raster-opacity"), F.lit(200).alias("raster-fade-duration"), *([F.lit(resampling).alias("raster-resampling")] if resampling else [])]
    top = [F.lit(maxzoom).alias("maxzoom")] if maxzoom is not None else []
    return F.struct(layer_id().alias("id"), F.lit("raster").alias("type"), source_id().alias("source"), F.col("minZoom").alias("minzoom"), *top, F.struct(shown.alias("visibility")).alias("layout"), F.struct(*paint).alias("paint"))


def binding(layers: DataFrame, **options) -> DataFrame:
    return layers.select("id", "ord", source_id().alias("source_id"), layer_id().alias("layer_id"), F.to_json(raster_source(**options)).alias("source"), F.to_json(raster_layer()).alias("layer")).filter("source IS NOT NULL")


def style(layers: DataFrame, name: str, visible_ids: list[str] | None = None, **options) -> DataFrame:
    """One row: the style document of all drawable layers, in catalogue order."""
    shown = F.col("id").isin(*visible_ids) if visible_ids is not None else F.lit(True)
    rows = layers.select("ord", source_id().alias("k"), raster_source(**options).alias("s"), raster_layer(visible=shown).alias("l")).filter("s IS NOT NULL")
    listed = F.sort_array(F.collect_list(F.struct("ord", "k", "s", "l")))
    sources = F.map_from_entries(F.transform(listed, lambda x: F.struct(x["k"], x["s"])))
    return rows.agg(F.to_json(F.struct(F.lit(8).alias("version"), F.lit(name).alias("name"), sources.alias("sources"), F.transform(listed, lambda x: x["l"]).alias("layers"))).alias("style"))


def leaflet_source(proxy: str | None = None, html: bool = True) -> Column:
    """kind, url and options; services without Web Mercator are drawn by the host's own tile requests."""
    b, wms, xyz = Box.of("bbox"), F.col("service.wms"), F.col("service.xyz")
    own = is_type("WMS") & needs_reprojection()
    common = [credit(html).alias("attribution"), F.col("minZoom").alias("minZoom"), F.col("maxZoom").alias("maxZoom"), F.array(F.array(b.s, b.w), F.array(b.n, b.e)).alias("bounds"), F.lit("anonymous").alias("crossOrigin")]
    ready = is_type("WMS") & ~needs_reprojection()
    kind = F.when(own, "tileLayer.custom").when(is_type("WMS"), "tileLayer.wms").when(is_type("WMTS") | is_type("XYZ"), "tileLayer")
    url = F.when(own, own_template()).when(is_type("WMS"), urls.through_proxy(F.col("service.url"), proxy)).when(is_type("WMTS"), urls.wmts_template(F.col("service.url"), F.col("service.wmts"), proxy)).when(is_type("XYZ"), urls.through_proxy(xyz["urlTemplate"], proxy))
    only = lambda c: F.when(ready, c)
    options = F.struct(
        *common, only(F.array_join(wms["layers"], ",")).alias("layers"), only(F.array_join(wms["styles"], ",")).alias("styles"), only(wms["format"]).alias("format"), only(wms["transparent"]).alias("transparent"),
        only(wms["version"]).alias("version"), only(F.lit(True)).alias("uppercase"), F.when(is_type("XYZ"), xyz["scheme"] == "tms").alias("tms"), F.when(F.size(xyz["subdomains"]) > 0, xyz["subdomains"]).alias("subdomains"),
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), url.alias("url"), options.alias("options")))


def openlayers_source(proxy: str | None = None, html: bool = True, tile: int | None = None) -> Column:
    wms, wmts, xyz = F.col("service.wms"), F.col("service.wmts"), F.col("service.xyz")
    own = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("LAYERS", "STYLES", "FORMAT", "TRANSPARENT", "VERSION", "TILED")]),
        F.array(F.array_join(wms["layers"], ","), F.array_join(wms["styles"], ","), wms["format"], wms["transparent"].cast("string"), wms["version"], F.lit("true")),
    )
    none = F.create_map().cast("map<string,string>")
    time = F.when(wms["time"] != "", F.create_map(F.lit("TIME"), wms["time"])).otherwise(none)
    extra = F.coalesce(wms["extraParams"], none)
    params = F.map_concat(F.map_filter(F.map_concat(own, time), lambda k, v: ~F.map_contains_key(extra, k)), extra)
    is_wms, is_wmts, is_xyz = is_type("WMS"), is_type("WMTS"), is_type("XYZ")
    rest = (wmts["requestEncoding"] == "REST") & wmts["urlTemplate"].isNotNull()
    url = F.when(is_wms, F.col("service.url")).when(is_wmts, F.when(rest, wmts["urlTemplate"]).otherwise(F.col("service.url")))
    return F.when(is_wms | is_wmts | is_xyz, F.struct(
        F.when(is_wms, "TileWMS").when(is_wmts, "WMTS").otherwise("XYZ").alias("kind"), urls.through_proxy(url, proxy).alias("url"), F.when(is_wms, params).alias("params"), F.when(is_wms, 200).alias("transition"),
        F.when(is_xyz, urls.xyz_templates(xyz, proxy=proxy)).alias("urls"), F.when(is_xyz, F.lit(tile) if tile else xyz["tileSize"]).alias("tileSize"), F.when(is_xyz, F.col("minZoom")).alias("minZoom"), F.when(is_xyz, F.col("maxZoom")).alias("maxZoom"),
        F.when(is_wmts, wmts["layer"]).alias("layer"), F.when(is_wmts, wmts["tileMatrixSet"]).alias("matrixSet"), F.when(is_wmts, wmts["format"]).alias("format"), F.when(is_wmts, wmts["style"]).alias("style"),
        F.when(is_wmts, wmts["requestEncoding"]).alias("requestEncoding"), F.when(is_wmts, wmts["crs"]).alias("projection"), F.when(is_wmts, wmts["dimensions"]).alias("dimensions"), F.lit("anonymous").alias("crossOrigin"), credit(html).alias("attributions"),
    ))


def mosaic_source(mosaic: str, attribution: Column, tile: int = 512, maxzoom: int = 19) -> Column:
    return F.struct(F.lit("raster").alias("type"), F.array(F.lit(mosaic_template(mosaic))).alias("tiles"), F.lit(tile).alias("tileSize"), F.lit(0).alias("minzoom"), F.lit(maxzoom).alias("maxzoom"), attribution.alias("attribution"))


def mosaic_opacity(zoom: Column, fade_from: float | None = None, fade_to: float | None = None, opacity: float = 1.0) -> Column:
    """Opacity at a zoom: linear between the two, constant without them."""
    if fade_from is None or fade_to is None or fade_to <= fade_from:
        return F.lit(opacity)
    return F.when(zoom <= fade_from, 0.0).when(zoom >= fade_to, opacity).otherwise((zoom - fade_from) / (fade_to - fade_from) * opacity)


def backdrop(spark, url: str, corners: list[tuple[float, float]], attribution: str, opacity: float = 1.0) -> DataFrame:
    """One row: an image source and its layer. corners: clockwise from the north-west."""
    one = spark.range(1)
    source = F.struct(F.lit("image").alias("type"), F.lit(url).alias("url"), F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in corners]).alias("coordinates"), F.lit(attribution).alias("attribution"))
    layer = F.struct(F.lit(f"{PREFIX}-backdrop").alias("id"), F.lit("raster").alias("type"), F.lit(f"{PREFIX}-backdrop").alias("source"), F.struct(F.lit(opacity).alias("raster-opacity")).alias("paint"))
    return one.select(F.to_json(source).alias("source"), F.to_json(layer).alias("layer"))


def host_allow_list(layers: DataFrame) -> DataFrame:
    """Distinct hosts of the catalogue, which a proxy may pass."""
    return layers.select(F.regexp_extract("service.url", "^[a-zA-Z]+://([^/:?#]+)", 1).alias("host")).filter("host <> ''").distinct()
