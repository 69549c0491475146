"""Capabilities documents of WMS and WMTS services as rows.

XML trees of unknown depth can't be columns, so one pass of Python over each document yields flat rows: WMS layers depth
first, each with what it inherits from those above it, and WMTS layers with their links. Everything after that is columns.
A document that can't be read gives a row with an error and its code, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import asin, degrees, sqrt, tanh

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapweave.functions import text as T
from mapweave.functions.boxes import Box
from mapweave.functions.crs import KNOWN, SAME, split_name
from mapweave.functions.mercator import RADIUS
from mapweave.functions.urls import is_mercator, order_crs, pick_preferred
from mapweave.schema import MERCATOR_WORLD, PARSE_ERROR, UNKNOWN, MapError
from mapweave.sources import xml as X
from mapweave.sources.collections import derive

_BOX = "STRUCT<min_lng: DOUBLE, min_lat: DOUBLE, max_lng: DOUBLE, max_lat: DOUBLE>"
_STYLE = "STRUCT<name: STRING, title: STRING, abstract: STRING, legend_url: STRING, legend_format: STRING, legend_width: DOUBLE, legend_height: DOUBLE>"
_DIMENSION = "STRUCT<name: STRING, units: STRING, `default`: STRING, values: STRING, nearest: BOOLEAN, current: BOOLEAN>"
_OPERATION = "STRUCT<url: STRING, post_url: STRING, formats: ARRAY<STRING>>"
WMS_ROW = f"""doc_id STRING, error STRING, error_code STRING, version STRING,
service STRUCT<name: STRING, title: STRING, abstract: STRING, keywords: ARRAY<STRING>, url: STRING, fees: STRING, constraints: STRING, organization: STRING, person: STRING,
email: STRING, layer_limit: INT, max_width: INT, max_height: INT>,
get_capabilities {_OPERATION}, get_map {_OPERATION}, get_feature_info {_OPERATION}, exception_formats ARRAY<STRING>, node INT, parent INT, depth INT, path ARRAY<STRING>, name STRING, title STRING,
abstract STRING, keywords ARRAY<STRING>, queryable BOOLEAN, opaque BOOLEAN, cascaded INT, crs ARRAY<STRING>, bbox {_BOX},
boxes ARRAY<STRUCT<crs: STRING, raw: ARRAY<DOUBLE>, bbox: ARRAY<DOUBLE>, resx: DOUBLE, resy: DOUBLE>>, styles ARRAY<{_STYLE}>, dimensions ARRAY<{_DIMENSION}>,
min_scale DOUBLE, max_scale DOUBLE, attribution STRUCT<title: STRING, url: STRING, logo: STRING>, metadata ARRAY<STRUCT<url: STRING, type: STRING, format: STRING>>"""
WMTS_ROW = f"""doc_id STRING, error STRING, error_code STRING, version STRING,
service STRUCT<title: STRING, abstract: STRING, keywords: ARRAY<STRING>, fees: STRING, constraints: STRING, provider: STRING, site: STRING>,
operations MAP<STRING, STRUCT<url: STRING, encodings: ARRAY<STRING>>>, node INT, identifier STRING, title STRING, abstract STRING, keywords ARRAY<STRING>, bbox {_BOX}, formats ARRAY<STRING>,
info_formats ARRAY<STRING>, queryable BOOLEAN, styles ARRAY<STRUCT<identifier: STRING, title: STRING, is_default: BOOLEAN, legend_url: STRING>>, links ARRAY<STRING>,
resources ARRAY<STRUCT<template: STRING, format: STRING, type: STRING>>, dimensions ARRAY<STRUCT<identifier: STRING, units: STRING, `default`: STRING, values: ARRAY<STRING>>>,
matrix_sets MAP<STRING, STRUCT<crs: STRING, well_known: STRING, matrices: ARRAY<STRUCT<identifier: STRING, scale: DOUBLE, left: DOUBLE, top: DOUBLE, tile_width: INT, tile_height: INT, width: INT, height: INT>>>>"""

#: Scale hints are the ground diagonal of a pixel of 0.28 mm.
HINT = 1 / (0.00028 * sqrt(2))


class _Names:
    """The rules of functions.crs for single strings, which the parsing of documents needs."""

    def __init__(self):
        self.alias = {}
        self.first = {c.code for c in KNOWN if c.axis == "latlon"}
        for c in KNOWN:
            for s in (c.code, c.code.replace(":", "::", 1), c.code.replace(":", "", 1), *c.aliases, *(a.replace(":", "::", 1) for a in c.aliases)):
                self.alias[" ".join(s.split()).upper()] = c.code

    def normalise(self, name: str) -> str:
        value = " ".join(name.split()).upper()
        if value in self.alias:
            return self.alias[value]
        found = split_name(value)
        if not found:
            return value
        authority, code = found
        whole = "CRS:84" if authority == "OGC" and code in ("CRS84", "84") else f"{authority}:{code}"
        return self.alias.get(whole, whole)

    def same(self, a: str, b: str) -> bool:
        return a == b or any(a in g and b in g for g in SAME)

    def swaps(self, code: str, version: str | None = None) -> bool:
        return code in self.first and version not in ("1.1.0", "1.1.1")


NAMES = _Names()


def _box(values) -> dict | None:
    return None if values is None else dict(zip(("min_lng", "min_lat", "max_lng", "max_lat"), values, strict=True))


def _operation(node) -> dict | None:
    if node is None:
        return None
    http = X.child(X.child(node, "DCPType"), "HTTP")
    return {"url": X.href(X.child(http, "Get")), "post_url": X.href(X.child(http, "Post")), "formats": X.texts(node, "Format")}


def _whole(x: float | None) -> int | None:
    return None if x is None else int(x)


def _wms_service(node) -> dict:
    contact = X.child(node, "ContactInformation")
    person = X.child(contact, "ContactPersonPrimary")
    t = X.child_text
    return {
        "name": t(node, "Name"), "title": t(node, "Title") or "Untitled service", "abstract": t(node, "Abstract"), "keywords": X.texts(X.child(node, "KeywordList"), "Keyword"), "url": X.href(node),
        "fees": t(node, "Fees"), "constraints": t(node, "AccessConstraints"), "organization": t(person, "ContactOrganization"), "person": t(person, "ContactPerson"), "email": t(contact, "ContactElectronicMailAddress"),
        "layer_limit": _whole(X.num(t(node, "LayerLimit"))), "max_width": _whole(X.num(t(node, "MaxWidth"))), "max_height": _whole(X.num(t(node, "MaxHeight"))),
    }


def _styles(node) -> list[dict]:
    out = []
    for s in X.children(node, "Style"):
        if name := X.child_text(s, "Name"):
            legend = X.child(s, "LegendURL")
            out.append({"name": name, "title": X.child_text(s, "Title"), "abstract": X.child_text(s, "Abstract"), "legend_url": X.href(legend), "legend_format": X.child_text(legend, "Format"), "legend_width": X.num_attr(legend, "width"), "legend_height": X.num_attr(legend, "height")})
    return out


def dimensions(node) -> list[dict]:
    """Dimensions, and the extents that old versions state apart: an extent's values win, its missing ones come from the dimension."""
    out: dict[str, dict] = {}
    for d in X.children(node, "Dimension"):
        if name := X.attr(d, "name"):
            out[name.lower()] = {"name": name, "units": X.attr(d, "units"), "default": X.attr(d, "default"), "values": X.text(d), "nearest": X.attr(d, "nearestValue") == "1", "current": X.attr(d, "current") == "1"}
    for e in X.children(node, "Extent"):
        if name := X.attr(e, "name"):
            old = out.get(name.lower(), {})
            out[name.lower()] = {
                "name": name, "units": old.get("units"), "default": X.attr(e, "default") or old.get("default"), "values": X.text(e) or old.get("values"),
                "nearest": X.attr(e, "nearestValue") == "1" or bool(old.get("nearest")), "current": X.attr(e, "current") == "1" or bool(old.get("current")),
            }
    return list(out.values())


def _boxes(node, version: str) -> list[dict]:
    out = []
    for b in X.children(node, "BoundingBox"):
        name, raw = X.attr(b, "CRS") or X.attr(b, "SRS"), [X.num_attr(b, k) for k in ("minx", "miny", "maxx", "maxy")]
        if name and None not in raw:
            code = NAMES.normalise(name)
            out.append({"crs": code, "raw": raw, "bbox": [raw[1], raw[0], raw[3], raw[2]] if NAMES.swaps(code, version) else raw, "resx": X.num_attr(b, "resx"), "resy": X.num_attr(b, "resy")})
    return out


def _stated_extent(node) -> list[float] | None:
    e = X.child(node, "EX_GeographicBoundingBox")
    if e is not None:
        got = [X.num(X.child_text(e, k)) for k in ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude")]
        if None not in got:
            return got
    e = X.child(node, "LatLonBoundingBox")
    got = [X.num_attr(e, k) for k in ("minx", "miny", "maxx", "maxy")]
    return None if None in got else got


def _derived_extent(boxes: list[dict]) -> list[float] | None:
    for b in boxes:
        if NAMES.same(b["crs"], "EPSG:4326"):
            return b["bbox"]
    for b in boxes:
        if NAMES.same(b["crs"], "EPSG:3857"):
            return [f(v) for f, v in zip((lambda x: degrees(x / RADIUS), lambda y: degrees(asin(tanh(y / RADIUS)))) * 2, b["bbox"], strict=True)]
    return None


def _scales(node) -> tuple[float | None, float | None]:
    low, high = X.num(X.child_text(node, "MinScaleDenominator")), X.num(X.child_text(node, "MaxScaleDenominator"))
    if low is not None or high is not None:
        return low, high
    hint = X.child(node, "ScaleHint")
    return tuple(None if v is None else v * HINT for v in (X.num_attr(hint, "min"), X.num_attr(hint, "max")))


def _credit(node) -> dict | None:
    a = X.child(node, "Attribution")
    out = {"title": X.child_text(a, "Title"), "url": X.href(a), "logo": X.href(X.child(a, "LogoURL"))}
    return out if any(out.values()) else None


def _merged(above: list[dict], own: list[dict], key: Callable[[dict], str]) -> list[dict]:
    """One item a key: its first place, its last value."""
    return list({**{key(x): x for x in above}, **{key(x): x for x in own}}.values())


_NOTHING: dict = {"crs": [], "boxes": [], "extent": None, "styles": [], "dimensions": [], "attribution": None, "queryable": False, "opaque": False, "cascaded": None, "scales": (None, None), "path": [], "depth": 0, "node": None}


def wms_rows(body: str | None, endpoint: str | None = None, prefer_advertised: bool = False) -> list[dict]:
    """Rows of all layers, named or not, depth first. Requests go to the endpoint unless the advertised address is preferred."""
    root = X.parse(body)
    X.raise_reported(root)
    if root.tag not in ("WMS_Capabilities", "WMT_MS_Capabilities", "Capabilities"):
        raise MapError(PARSE_ERROR, "not a WMS capabilities document")
    version = {"1.3.0": "1.3.0", "1.3": "1.3.0", "1.1.1": "1.1.1", "1.1.0": "1.1.0"}.get(X.attr(root, "version") or "", "1.1.1" if root.tag == "WMT_MS_Capabilities" else "1.3.0")
    capability = X.child(root, "Capability")
    request = X.child(capability, "Request")
    operations = {"get_capabilities": _operation(X.child(request, "GetCapabilities", "Capabilities")), "get_map": _operation(X.child(request, "GetMap", "Map")), "get_feature_info": _operation(X.child(request, "GetFeatureInfo", "FeatureInfo"))}
    if endpoint and not prefer_advertised:
        operations = {k: o and {**o, "url": endpoint} for k, o in operations.items()}
    head = {"version": version, "service": _wms_service(X.child(root, "Service")), **operations, "exception_formats": X.texts(X.child(capability, "Exception"), "Format")}
    rows: list[dict] = []
    open_ = [(X.child(capability, "Layer"), _NOTHING)] if X.child(capability, "Layer") is not None else []
    while open_:  # a stack, since documents may nest deeper than Python calls
        node, above = open_.pop()
        own_boxes = _boxes(node, version)
        boxes = _merged(above["boxes"], own_boxes, lambda b: b["crs"])
        crs = list(dict.fromkeys([*above["crs"], *(NAMES.normalise(c) for tag in ("CRS", "SRS") for e in X.children(node, tag) for c in X.split_list(X.text(e)))]))
        flag = lambda name, node=node, above=above: above[name] if X.attr(node, name) is None else X.attr(node, name) == "1"
        name = X.child_text(node, "Name")
        title = X.child_text(node, "Title") or name or "Untitled layer"
        cascaded = X.num_attr(node, "cascaded")
        here = {
            "crs": crs, "boxes": boxes, "extent": _stated_extent(node) or _derived_extent(own_boxes) or above["extent"] or _derived_extent(boxes), "styles": _merged(above["styles"], _styles(node), lambda s: s["name"]),
            "dimensions": _merged(above["dimensions"], dimensions(node), lambda d: d["name"].lower()), "attribution": _credit(node) or above["attribution"], "queryable": flag("queryable"), "opaque": flag("opaque"),
            "cascaded": above["cascaded"] if cascaded is None else int(cascaded), "scales": tuple(b if a is None else a for a, b in zip(_scales(node), above["scales"], strict=True)),
            "path": [*above["path"], title], "depth": above["depth"] + 1, "node": len(rows),
        }
        metadata = [{"url": u, "type": X.attr(m, "type"), "format": X.child_text(m, "Format")} for m in X.children(node, "MetadataURL") if (u := X.href(m))]
        rows.append({
            **head, "node": len(rows), "parent": above["node"], "depth": above["depth"], "path": above["path"], "name": name, "title": title, "abstract": X.child_text(node, "Abstract"),
            "keywords": X.texts(X.child(node, "KeywordList"), "Keyword"), "queryable": here["queryable"], "opaque": here["opaque"], "cascaded": here["cascaded"], "crs": crs, "bbox": _box(here["extent"]), "boxes": boxes,
            "styles": here["styles"], "dimensions": here["dimensions"], "min_scale": here["scales"][0], "max_scale": here["scales"][1], "attribution": here["attribution"], "metadata": metadata,
        })
        open_ += [(c, here) for c in reversed(X.children(node, "Layer"))]
    return rows or [head]


def _corner(value: str | None, code: str | None = None) -> list[float] | None:
    got = [X.num(x) for x in X.split_list(value)[:2]]
    if len(got) < 2 or None in got:
        return None
    return got[::-1] if code and NAMES.swaps(code) else got


def _corners(node, code: str | None = None) -> dict | None:
    low, high = _corner(X.child_text(node, "LowerCorner"), code), _corner(X.child_text(node, "UpperCorner"), code)
    return _box([*low, *high]) if low and high else None


def _wmts_extent(layer) -> dict | None:
    if out := _corners(X.child(layer, "WGS84BoundingBox")):
        return out
    for b in X.children(layer, "BoundingBox"):
        code = NAMES.normalise(X.attr(b, "crs") or X.attr(b, "CRS") or "")
        if code in ("EPSG:4326", "CRS:84") and (out := _corners(b, code)):
            return out
    return None


def _matrix(node, code: str) -> dict | None:
    t = lambda k: X.num(X.child_text(node, k))
    corner = _corner(X.child_text(node, "TopLeftCorner"), code)
    sizes = [t(k) for k in ("TileWidth", "TileHeight", "MatrixWidth", "MatrixHeight")]
    if not X.child_text(node, "Identifier") or t("ScaleDenominator") is None or corner is None or None in sizes:
        return None
    return {"identifier": X.child_text(node, "Identifier"), "scale": t("ScaleDenominator"), "left": corner[0], "top": corner[1], **dict(zip(("tile_width", "tile_height", "width", "height"), map(int, sizes), strict=True))}


def wmts_rows(body: str | None) -> list[dict]:
    root = X.parse(body)
    X.raise_reported(root)
    if root.tag != "Capabilities":
        raise MapError(PARSE_ERROR, "not a WMTS capabilities document")
    t = X.child_text
    about, provider, contents = X.child(root, "ServiceIdentification"), X.child(root, "ServiceProvider"), X.child(root, "Contents")
    operations = {}
    for o in X.children(X.child(root, "OperationsMetadata"), "Operation"):
        get = X.child(X.child(X.child(o, "DCP"), "HTTP"), "Get")
        if (name := X.attr(o, "name")) in ("GetCapabilities", "GetTile", "GetFeatureInfo"):
            encodings = [v for c in X.children(get, "Constraint") if X.attr(c, "name") == "GetEncoding" for v in X.texts(X.child(c, "AllowedValues"), "Value")]
            operations[name] = {"url": X.attr(get, "href"), "encodings": encodings}
    sets = {}
    for s in X.children(contents, "TileMatrixSet"):
        if (name := t(s, "Identifier")) and t(s, "SupportedCRS"):
            code = NAMES.normalise(t(s, "SupportedCRS"))
            sets[name] = {"crs": code, "well_known": t(s, "WellKnownScaleSet"), "matrices": [m for e in X.children(s, "TileMatrix") if (m := _matrix(e, code))]}
    head = {
        "version": X.attr(root, "version") or "1.0.0", "operations": operations, "matrix_sets": sets,
        "service": {"title": t(about, "Title") or "Untitled service", "abstract": t(about, "Abstract"), "keywords": X.texts(X.child(about, "Keywords"), "Keyword"), "fees": t(about, "Fees"), "constraints": t(about, "AccessConstraints"), "provider": t(provider, "ProviderName"), "site": X.attr(X.child(provider, "ProviderSite"), "href")},
    }
    rows = []
    for layer in X.children(contents, "Layer"):
        if not (name := t(layer, "Identifier")):
            continue
        info = X.texts(layer, "InfoFormat")
        rows.append({
            **head, "node": len(rows), "identifier": name, "title": t(layer, "Title") or name, "abstract": t(layer, "Abstract"), "keywords": X.texts(X.child(layer, "Keywords"), "Keyword"), "bbox": _wmts_extent(layer),
            "formats": X.texts(layer, "Format"), "info_formats": info, "queryable": bool(info),
            "styles": [{"identifier": i, "title": t(s, "Title"), "is_default": X.attr(s, "isDefault") in ("true", "1"), "legend_url": X.attr(X.child(s, "LegendURL"), "href")} for s in X.children(layer, "Style") if (i := t(s, "Identifier"))],
            "links": [v for e in X.children(layer, "TileMatrixSetLink") if (v := t(e, "TileMatrixSet"))],
            "resources": [{"template": v, "format": X.attr(e, "format") or "image/png", "type": X.attr(e, "resourceType") or "tile"} for e in X.children(layer, "ResourceURL") if (v := X.attr(e, "template"))],
            "dimensions": [{"identifier": i, "units": t(e, "UOM"), "default": t(e, "Default"), "values": X.texts(e, "Value")} for e in X.children(layer, "Dimension") if (i := t(e, "Identifier"))],
        })
    return rows or [head]


def _parsed(docs: DataFrame, rows_of: Callable[[str | None, str | None], list[dict]], schema: str) -> DataFrame:
    """docs: doc_id, xml and, if there, url. Rows travel as JSON, which Spark reads into the schema."""

    def each(batches):
        for batch in batches:
            out = []
            for doc, body, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = rows_of(body, url)
                except MapError as error:
                    rows = [{"error": str(error), "error_code": error.code}]
                except Exception as error:  # noqa: BLE001  one odd document must not end a sweep
                    rows = [{"error": str(error), "error_code": UNKNOWN}]
                out += [json.dumps({"doc_id": doc, **r}) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["row"])

    url = F.col("url").cast("string") if "url" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("string"), F.col("xml").cast("string"), url.alias("url")).mapInArrow(each, "row string")
    kind = StructType.fromDDL(schema)
    return rows.select(F.from_json("row", kind).alias("r")).select("r.*")


def parse_wms(docs: DataFrame, prefer_advertised: bool = False) -> DataFrame:
    """A row for each layer of each document, in document order (node); filter(name is not null) gives those that can be requested."""
    return _parsed(docs, lambda body, url: wms_rows(body, url, prefer_advertised), WMS_ROW)


def parse_wmts(docs: DataFrame) -> DataFrame:
    return _parsed(docs, lambda body, url: wmts_rows(body), WMTS_ROW)


def find_layer(rows: DataFrame, name: str, column: str = "name") -> DataFrame:
    """The first layer of that name in each document."""
    first = rows.filter(F.col(column) == name).groupBy("doc_id").agg(F.min("node").alias("node"))
    return rows.join(first, ["doc_id", "node"])


FORMATS = ["image/png", "image/jpeg", "image/webp", "image/gif"]


def _to_layers(rows: DataFrame, service: Column, id: Column, attribution: Column, tags: Column, metadata: Column, category: str, provider: dict, license: dict, country: str, nuts: str | None, region: str | None) -> DataFrame:
    text = lambda v: F.lit(v).cast("string")
    named = lambda d, keys: F.struct(*[text(d.get(k)).alias(k) for k in keys])
    world = Box.at(MERCATOR_WORLD).struct()
    bbox = F.when(F.col("bbox.min_lng").isNotNull(), F.col("bbox")).otherwise(world)
    none = text(None)
    return derive(rows.select(
        id.alias("id"), "title", F.col("abstract").alias("description"), text(category).alias("category"), named(provider, ("name", "url", "shortName")).alias("provider"), text(country).alias("country"), text(nuts).alias("nuts"),
        text(region).alias("regionName"), bbox.alias("bbox"), F.lit(None).cast(f"array<{_BOX}>").alias("coverage"), service.alias("service"), named(license, ("id", "name", "url", "notes")).alias("license"), attribution.alias("attribution"),
        F.lit(0).alias("minZoom"), F.lit(20).alias("maxZoom"), F.lit(None).cast("double").alias("resolutionMeters"), F.lit(None).cast("struct<start: string, end: string>").alias("temporal"), tags.alias("tags"), text("active").alias("status"),
        metadata.alias("metadataUrl"), none.alias("documentationUrl"), none.alias("lastVerified"), F.col("doc_id").alias("source_file"), text(country).alias("scope"), F.col("node").cast("long").alias("ord"),
    ))


def _service_struct(kind: str, url: Column, value: Column) -> Column:
    from mapweave.schema import LAYER

    types = {f.name: f for f in StructType.fromDDL(LAYER)["service"].dataType}
    return F.struct(F.lit(kind).alias("type"), url.alias("url"), *[(value if k == kind.lower() else F.lit(None)).cast(types[k].dataType).alias(k) for k in ("wms", "wmts", "xyz", "wfs", "cog")])


def wms_to_layers(rows: DataFrame, category: str, provider: dict, license: dict, country: str, nuts: str | None = None, region: str | None = None, attribution: str | None = None) -> DataFrame:
    """Catalogue rows of the named layers whose service says where to ask."""
    url = F.coalesce("get_map.url", "service.url")
    named = rows.filter(F.col("name").isNotNull() & url.isNotNull())
    none = F.array().cast("array<string>")
    wms = F.struct(
        F.array("name").alias("layers"), F.when(F.size("styles") > 0, F.array(F.get("styles", F.lit(0))["name"])).otherwise(none).alias("styles"), pick_preferred(F.coalesce("get_map.formats", none), FORMATS, "image/png").alias("format"),
        F.coalesce("get_feature_info.formats", none).alias("infoFormats"), order_crs(F.col("crs")).alias("crs"), F.col("version").alias("version"), F.col("queryable").alias("queryable"),
        F.lit(category not in ("orthophoto", "satellite")).alias("transparent"), F.lit(256).alias("tileSize"), F.lit(None).cast("string").alias("time"), F.col("service.max_width").alias("maxWidth"), F.col("service.max_height").alias("maxHeight"),
        F.lit(None).cast("map<string,string>").alias("extraParams"),
    )
    credit = F.coalesce(F.lit(attribution), F.col("attribution.title"), F.lit(provider.get("shortName")), F.lit(provider["name"]))
    return _to_layers(named, _service_struct("WMS", url, wms), T.layer_id(F.lit(country), F.col("name")), credit, F.slice("keywords", 1, 12), F.get("metadata", F.lit(0))["url"], category, provider, license, country, nuts, region)


def wmts_to_layers(rows: DataFrame, category: str, provider: dict, license: dict, country: str, nuts: str | None = None, region: str | None = None, attribution: str | None = None, matrix_set: str | None = None) -> DataFrame:
    """Catalogue rows; of a layer's matrix sets the first in Mercator is taken, else the first."""
    url = F.coalesce(F.element_at("operations", "GetTile")["url"], F.element_at("operations", "GetCapabilities")["url"])
    rest = F.get(F.filter("resources", lambda r: r["type"] == "tile"), F.lit(0))["template"]
    mercator = F.get(F.filter("links", lambda s: F.coalesce(is_mercator(F.element_at(F.col("matrix_sets"), s)["crs"]), F.lit(False))), F.lit(0))
    chosen = F.coalesce(F.lit(matrix_set).cast("string"), mercator, F.get("links", F.lit(0)))
    usable = rows.filter(F.col("identifier").isNotNull()).withColumn("set", chosen).withColumn("rest", rest).withColumn("url", url).filter("set IS NOT NULL AND (url IS NOT NULL OR rest IS NOT NULL)")
    of_set = F.element_at("matrix_sets", F.col("set"))
    style = F.coalesce(F.get(F.filter("styles", lambda s: s["is_default"]), F.lit(0))["identifier"], F.get("styles", F.lit(0))["identifier"], F.lit("default"))
    wide = F.coalesce(F.get(of_set["matrices"], F.lit(0))["tile_width"] == 512, F.lit(False))
    wmts = F.struct(
        F.col("identifier").alias("layer"), F.col("set").alias("tileMatrixSet"), style.alias("style"), pick_preferred(F.col("formats"), FORMATS, "image/png").alias("format"), F.lit("1.0.0").alias("version"),
        F.when(F.col("rest").isNotNull() & F.col("url").isNull(), "REST").otherwise("KVP").alias("requestEncoding"), F.col("rest").alias("urlTemplate"), F.coalesce(of_set["crs"], F.lit("EPSG:3857")).alias("crs"), F.when(wide, 512).otherwise(256).alias("tileSize"),
        F.lit(None).cast("string").alias("tileMatrixTemplate"), F.lit(None).cast("map<string,string>").alias("dimensions"), F.col("queryable").alias("queryable"), F.col("info_formats").alias("infoFormats"),
    )
    credit = F.coalesce(F.lit(attribution), F.lit(provider.get("shortName")), F.lit(provider["name"]))
    service = _service_struct("WMTS", F.coalesce("url", "rest"), wmts)
    return _to_layers(usable, service, T.layer_id(F.lit(country), F.col("identifier")), credit, F.slice("keywords", 1, 12), F.lit(None).cast("string"), category, provider, license, country, nuts, region)
