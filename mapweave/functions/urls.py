"""Request URLs of map services as columns.

Systems are canonical codes here, as layer rows have them (functions.crs.REGISTRY.normalise makes them from any spelling).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.boxes import Box
from mapweave.functions.crs import REGISTRY, SAME, same_codes
from mapweave.functions.mercator import meters_per_pixel, project, project_box, tile_box, tile_box_projected
from mapweave.functions.text import number

MERCATOR = "EPSG:3857"
# Systems in degrees that requests fall back to, in order.
DEGREES = ["CRS:84", "EPSG:4326", "EPSG:4258", "EPSG:6706"]
# Formats of feature information in order of preference.
INFO_PREFERENCE = ["application/geo+json", "application/json", "text/html", "application/vnd.ogc.gml", "text/xml", "text/plain"]
PLACEHOLDER = "{bbox-epsg-3857}"


def encode_component(text: Column) -> Column:
    """Percent-encoding as browsers do it; the form encoding below escapes a few characters more."""
    out = F.url_encode(text)
    for escaped, plain in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, escaped, plain)
    return out


def encode_value(text: Column) -> Column:
    """Commas and colons stay, since services take lists and codes literally."""
    return F.regexp_replace(F.regexp_replace(encode_component(text), "%2C", ","), "%3A", ":")


def with_query(base: Column, params: list[tuple[str, Column]], extra: Column | None = None, raw: list[tuple[str, Column]] | None = None) -> Column:
    """base with parameters; null ones are left out. extra: a map whose entries replace parameters in place or follow them. raw ones go in as they are."""
    given = F.coalesce(extra, F.create_map().cast("map<string,string>")) if extra is not None else None
    listed = []
    for key, value in params:
        value = value.cast("string") if given is None else F.coalesce(F.element_at(given, key), value.cast("string"))
        listed.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), encode_value(value))))
    parts = F.array(*listed) if listed else F.array().cast("array<string>")
    if given is not None:
        names = [F.lit(k) for k, _ in params]
        others = F.filter(F.map_entries(given), lambda e: ~e["key"].isin(*names)) if names else F.map_entries(given)
        parts = F.concat(parts, F.transform(others, lambda e: F.concat(e["key"], F.lit("="), encode_value(e["value"]))))
    if raw:
        parts = F.concat(parts, F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in raw]))
    query = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "&")
    joint = F.when(base.rlike("[?&]$"), "").when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return F.when(query == "", base).otherwise(F.concat(base, joint, query))


def restore_placeholders(url: Column) -> Column:
    return F.regexp_replace(url, "%7B([A-Za-z0-9_.:-]+)%7D", "{$1}")


def through_proxy(url: Column, proxy: str | None) -> Column:
    if not proxy:
        return url
    if "{url}" in proxy:
        before, _, after = proxy.partition("{url}")
        return restore_placeholders(F.concat(F.lit(before), encode_component(url), F.lit(after)))
    if proxy.endswith("="):
        return restore_placeholders(F.concat(F.lit(proxy), encode_component(url)))
    return F.concat(F.lit(proxy), url)


def format_box(box: Box, crs: Column, version: Column | None = None, precision: int | None = None, separator: str = ",") -> Column:
    swapped = F.array(box.s, box.w, box.n, box.e)
    ordered = F.when(REGISTRY.code_latitude_first(crs, version), swapped).otherwise(box.array())
    return F.array_join(F.transform(ordered, lambda v: number(v, precision)), separator)


def parse_box(text: Column, crs: Column, version: Column | None = None) -> Column:
    """Struct of the first four numbers, longitude first; null with fewer. Trailing letters after a number are ignored."""
    leading = F.transform(F.split(text, ","), lambda p: F.regexp_extract(F.trim(p), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0))
    numbers = F.transform(F.filter(leading, lambda p: p != ""), lambda p: p.cast("double"))
    return F.when(F.size(numbers) >= 4, Box.from_array(numbers).swapped(REGISTRY.code_latitude_first(crs, version)).struct())


def get_param(url: Column, name: str) -> Column:
    """The first value of a query parameter, whatever its case."""
    entries = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    hit = F.get(F.filter(entries, lambda e: F.lower(F.split(e, "=")[0]) == name.lower()), F.lit(0))
    return F.when(hit.isNotNull(), F.url_decode(F.regexp_replace(hit, "^[^=]*=?", "")))


def without_params(url: Column, names: list[str]) -> Column:
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda e: (e != "") & ~F.lower(F.split(e, "=")[0]).isin(*[n.lower() for n in names])), "&")
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


# Versions asked for by default.
VERSIONS = {"WMS": "1.3.0", "WMTS": "1.0.0", "WFS": "2.0.0"}


def capabilities_url(url: Column, service: str = "WMS", version: str | None = None) -> Column:
    """SERVICE, REQUEST and VERSION replace those that the URL has in any spelling."""
    base = without_params(url, ["service", "request", "version"])
    base = F.when(base.rlike("^[a-zA-Z]+://[^/?#]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    return with_query(base, [("SERVICE", F.lit(service)), ("REQUEST", F.lit("GetCapabilities")), ("VERSION", F.lit(version or VERSIONS[service]))])


def base_url(url: Column) -> Column:
    out = without_params(url, ["service", "request", "version"])
    return F.when(out.rlike("^[a-zA-Z]+://[^/?#]+$"), F.concat(out, F.lit("/"))).otherwise(out)


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def is_mercator(code: Column) -> Column:
    return code.isin(*SAME[0])


def _like(code: Column, wanted: str) -> Column:
    """Equal or equivalent to a fixed code."""
    return code.isin(*next((g for g in SAME if wanted in g), [wanted]))


def supports_mercator(crs: Column) -> Column:
    """crs: the array of a service's systems."""
    return F.exists(crs, is_mercator)


def _is_like(wanted: str):
    return lambda c: _like(c, wanted)


def tile_crs(crs: Column, wanted: Column | str) -> Column:
    """The service's own code of the wanted system if it has it."""
    if isinstance(wanted, str):
        return F.coalesce(_first(crs, lambda c: _like(c, wanted)), F.lit(wanted))
    return F.coalesce(_first(crs, lambda c: same_codes(c, wanted)), wanted)


def reprojection_crs(crs: Column) -> Column:
    """The first system in degrees that the service lists; null if it has none."""
    return _first(crs, lambda c: c.isin(*{x for d in DEGREES for g in ([d], *SAME) if d in g for x in g}))


def query_crs(crs: Column, wanted: str | None = None) -> Column:
    """For feature information: the wanted system, Mercator, or one in degrees by preference; null if there is none."""
    if wanted:
        return F.lit(wanted)
    return F.coalesce(_first(crs, is_mercator), *[_first(crs, _is_like(d)) for d in DEGREES])


def pick_preferred(available: Column, preferred: list[str], otherwise: str) -> Column:
    """The first format that begins like a preferred one, in order of preference; else the first; else `otherwise`."""
    begins = lambda p: lambda f: F.startswith(F.lower(f), F.lit(p))
    hits = [_first(available, begins(p)) for p in preferred]
    return F.coalesce(*hits, F.get(available, F.lit(0)), F.lit(otherwise))


def pick_info_format(available: Column, wanted: str | None = None) -> Column:
    return F.lit(wanted) if wanted else pick_preferred(available, INFO_PREFERENCE, "text/html")


def order_crs(available: Column) -> Column:
    """Mercator, then the common systems in degrees, then the rest as listed; Mercator alone if nothing is listed."""
    first = F.array(*[_first(available, _is_like(p)) for p in (MERCATOR, "EPSG:4326", "CRS:84")])
    ordered = F.array_union(F.filter(first, lambda c: c.isNotNull()), available)
    return F.when(F.size(ordered) > 0, ordered).otherwise(F.array(F.lit(MERCATOR)))


def _yes(b: Column) -> Column:
    return F.when(b, "TRUE").otherwise("FALSE")


def _list(a: Column) -> Column:
    return F.array_join(a, ",")


def _map_params(wms: Column, crs: Column, width: Column, height: Column, both_spellings: bool = True, time: str | None = None) -> list[tuple[str, Column]]:
    new = wms["version"] == "1.3.0"
    return [
        ("SERVICE", F.lit("WMS")), ("VERSION", wms["version"]), ("REQUEST", F.lit("GetMap")), ("LAYERS", _list(wms["layers"])), ("STYLES", _list(wms["styles"])),
        ("FORMAT", wms["format"]), ("TRANSPARENT", _yes(wms["transparent"])), ("WIDTH", width), ("HEIGHT", height),
        *([("SRS", F.when(F.lit(both_spellings) | ~new, crs))]),
        ("CRS", F.when(F.lit(both_spellings) | new, crs)), ("TIME", F.lit(time) if time else F.when(wms["time"] != "", wms["time"])),
    ]


def get_map_url(url: Column, wms: Column, box: Box, width: Column, height: Column, crs: Column | None = None, proxy: str | None = None) -> Column:
    code = tile_crs(wms["crs"], crs if crs is not None else MERCATOR)
    params = _map_params(wms, code, width, height)
    return through_proxy(with_query(url, [*params, ("BBOX", format_box(box, code, wms["version"]))], wms["extraParams"]), proxy)


def wms_template(url: Column, wms: Column, crs: str = MERCATOR, proxy: str | None = None) -> Column:
    code = tile_crs(wms["crs"], crs)
    params = _map_params(wms, code, wms["tileSize"], wms["tileSize"])
    return through_proxy(with_query(url, params, wms["extraParams"], [("BBOX", F.lit(PLACEHOLDER))]), proxy)


def legend_url(url: Column, wms: Column, style: str | None = None, format: str = "image/png", proxy: str | None = None) -> Column:
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    params = [
        ("SERVICE", F.lit("WMS")), ("VERSION", wms["version"]), ("REQUEST", F.lit("GetLegendGraphic")), ("LAYER", first(wms["layers"])),
        ("STYLE", F.lit(style) if style is not None else first(wms["styles"])), ("FORMAT", F.lit(format)),
    ]
    return through_proxy(with_query(url, params), proxy)


def fill_rest(template: Column, layer: Column, style: Column, matrix_set: Column, dimensions: Column) -> Column:
    """Placeholders of a REST template, whatever their case; unknown ones stay."""
    out = template
    literal = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    for name, value in (("tilematrixset", literal(matrix_set)), ("tilematrix", F.lit("{z}")), ("tilerow", F.lit("{y}")), ("tilecol", F.lit("{x}")), ("layer", literal(layer)), ("style", literal(style))):
        out = F.regexp_replace(out, F.lit(rf"(?i)\{{{name}\}}"), value)
    entries = F.coalesce(F.map_entries(dimensions), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, out, lambda text, e: F.regexp_replace(text, F.concat(F.lit(r"(?i)\{"), F.regexp_replace(e["key"], r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\}")), literal(e["value"])))


def wmts_template(url: Column, wmts: Column, proxy: str | None = None) -> Column:
    """Null where REST is declared and no template is there."""
    template = F.coalesce(wmts["urlTemplate"], url)
    rest = F.when(F.contains(template, F.lit("{")), fill_rest(template, wmts["layer"], wmts["style"], wmts["tileMatrixSet"], wmts["dimensions"]))
    params = [
        ("SERVICE", F.lit("WMTS")), ("VERSION", wmts["version"]), ("REQUEST", F.lit("GetTile")), ("LAYER", wmts["layer"]), ("STYLE", wmts["style"]),
        ("FORMAT", wmts["format"]), ("TILEMATRIXSET", wmts["tileMatrixSet"]),
    ]
    raw = [("TILEMATRIX", F.coalesce(wmts["tileMatrixTemplate"], F.lit("{z}"))), ("TILEROW", F.lit("{y}")), ("TILECOL", F.lit("{x}"))]
    return through_proxy(F.when(wmts["requestEncoding"] == "REST", rest).otherwise(with_query(url, params, wmts["dimensions"], raw)), proxy)


def xyz_templates(xyz: Column, extra: dict[str, str] | None = None, proxy: str | None = None) -> Column:
    """One template for each subdomain, if the template asks for one."""
    template = with_query(xyz["urlTemplate"], [(k, F.lit(v)) for k, v in (extra or {}).items()])
    many = (F.size(xyz["subdomains"]) > 0) & template.rlike(r"\{[sa]\}")
    urls = F.when(many, F.transform(xyz["subdomains"], lambda s: F.regexp_replace(template, F.lit(r"\{[sa]\}"), s))).otherwise(F.array(template))
    return F.transform(urls, lambda u: through_proxy(u, proxy))


def fill_tile(template: Column, x: Column, y: Column, z: Column) -> Column:
    for name, v in (("z", z), ("x", x), ("y", y)):
        template = F.regexp_replace(template, F.lit(rf"\{{{name}\}}"), v.cast("string"))
    return template


def tile_url(service: Column, x: Column, y: Column, z: Column, tile: int | None = None, proxy: str | None = None) -> Column:
    """The request for one tile of a service; null for services without tiles."""
    wms, xyz = service["wms"], service["xyz"]
    size = F.lit(tile) if tile else wms["tileSize"]
    mercator = supports_mercator(wms["crs"])
    p, g = tile_box_projected(x, y, z), tile_box(x, y, z)
    box = Box(*(F.when(mercator, a).otherwise(b) for a, b in ((p.w, g.w), (p.s, g.s), (p.e, g.e), (p.n, g.n))))
    crs = F.when(mercator, F.lit(MERCATOR)).otherwise(reprojection_crs(wms["crs"]))
    templates = xyz_templates(xyz, proxy=proxy)
    row = F.when(xyz["scheme"] == "tms", F.pow(F.lit(2.0), z).cast("long") - 1 - y).otherwise(y)
    of_xyz = fill_tile(F.get(templates, (F.abs(x + y) % F.size(templates)).cast("int")), x, row, z)
    return (
        F.when(service["type"] == "WMS", F.when(crs.isNotNull(), get_map_url(service["url"], wms, box, size, size, crs, proxy)))
        .when(service["type"] == "WMTS", fill_tile(wmts_template(service["url"], service["wmts"], proxy), x, y, z)).when(service["type"] == "XYZ", of_xyz)
    )


def get_feature_url(url: Column, wfs: Column, box: Box | None = None, count: int | None = None, cql: str | None = None, properties: list[str] | None = None, sort: str | None = None, output: str | None = None, crs: str | None = None, proxy: str | None = None) -> Column:
    two = wfs["version"] == "2.0.0"
    code = F.lit(crs) if crs else wfs["crs"]
    limit = F.lit(count) if count is not None else wfs["maxFeatures"]
    params = [
        ("SERVICE", F.lit("WFS")), ("VERSION", wfs["version"]), ("REQUEST", F.lit("GetFeature")), ("TYPENAMES", F.when(two, _list(wfs["typeNames"]))),
        ("TYPENAME", F.when(~two, _list(wfs["typeNames"]))), ("OUTPUTFORMAT", F.lit(output) if output else wfs["outputFormat"]), ("SRSNAME", code),
        ("COUNT", F.when(two, limit)), ("MAXFEATURES", F.when(~two, limit)),
    ]
    if box is not None:
        params.append(("BBOX", F.concat(format_box(box, code), F.lit(","), code)))
    params += [(k, F.lit(v)) for k, v in (("CQL_FILTER", cql), ("PROPERTYNAME", ",".join(properties or [])), ("SORTBY", sort)) if v]
    return through_proxy(with_query(url, params, wfs["extraParams"]), proxy)


WINDOW = 101
METRES_PER_DEGREE = 111320.0


def js_round(x: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(x + 0.5)


def click_window(lng: Column, lat: Column, view: Box | None = None, width: int | None = None, height: int | None = None, zoom: Column | None = None) -> Column:
    """Struct of the request window (Mercator) and the pixel of a click: within a view of so many pixels, or a square around the point."""
    x, y = project(lng, lat)
    if view is not None and width and height:
        b = project_box(view)
        i, j = js_round((x - b.w) / (b.e - b.w) * width), js_round((b.n - y) / (b.n - b.s) * height)
        pixel = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
        return F.struct(F.lit(MERCATOR).alias("crs"), b.struct().alias("bbox"), F.lit(width).alias("width"), F.lit(height).alias("height"), pixel(i, width).alias("i"), pixel(j, height).alias("j"))
    size = min(width, height) if width and height else WINDOW
    half = size / 2 * meters_per_pixel(zoom if zoom is not None else F.lit(16.0))
    b = Box(x - half, y - half, x + half, y + half)
    return F.struct(F.lit(MERCATOR).alias("crs"), b.struct().alias("bbox"), F.lit(size).alias("width"), F.lit(size).alias("height"), F.lit(size // 2).alias("i"), F.lit(size // 2).alias("j"))


def click_window_degrees(lng: Column, lat: Column, crs: Column, zoom: Column | None = None) -> Column:
    half = WINDOW / 2 * meters_per_pixel(zoom if zoom is not None else F.lit(16.0))
    up, across = half / METRES_PER_DEGREE, half / (METRES_PER_DEGREE * F.greatest(F.lit(0.05), F.cos(F.radians(lat))))
    b = Box(lng - across, lat - up, lng + across, lat + up)
    return F.struct(crs.alias("crs"), b.struct().alias("bbox"), F.lit(WINDOW).alias("width"), F.lit(WINDOW).alias("height"), F.lit(WINDOW // 2).alias("i"), F.lit(WINDOW // 2).alias("j"))


def feature_info_url(url: Column, wms: Column, lng: Column, lat: Column, count: int = 10, wanted: str | None = None, buffer: int | None = None, proxy: str | None = None) -> Column:
    """Null where the service has no system that a click can be asked in."""
    crs, new = query_crs(wms["crs"]), wms["version"] == "1.3.0"
    m, d = click_window(lng, lat), click_window_degrees(lng, lat, crs)
    w = F.when(is_mercator(crs), F.struct(m["bbox"].alias("bbox"), m["width"].alias("width"), m["height"].alias("height"), m["i"].alias("i"), m["j"].alias("j"))).otherwise(
        F.struct(d["bbox"].alias("bbox"), d["width"].alias("width"), d["height"].alias("height"), d["i"].alias("i"), d["j"].alias("j"))
    )
    names = _list(wms["layers"])
    params = [
        ("SERVICE", F.lit("WMS")), ("VERSION", wms["version"]), ("REQUEST", F.lit("GetFeatureInfo")), ("LAYERS", names), ("QUERY_LAYERS", names),
        ("STYLES", _list(wms["styles"])), ("FORMAT", wms["format"]), ("TRANSPARENT", _yes(wms["transparent"])), ("INFO_FORMAT", pick_info_format(wms["infoFormats"], wanted)),
        ("FEATURE_COUNT", F.lit(count)), ("WIDTH", w["width"]), ("HEIGHT", w["height"]), ("CRS", F.when(new, crs)), ("I", F.when(new, w["i"])), ("J", F.when(new, w["j"])),
        ("SRS", F.when(~new, crs)), ("X", F.when(~new, w["i"])), ("Y", F.when(~new, w["j"])), ("BBOX", format_box(Box.of(w["bbox"]), crs, wms["version"])),
    ]
    if buffer is not None:
        params += [("BUFFER", F.lit(buffer)), ("RADIUS", F.lit(buffer))]
    return F.when(crs.isNotNull(), through_proxy(with_query(url, params, wms["extraParams"]), proxy))
