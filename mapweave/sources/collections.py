"""Collections of layer records: read as JSON, normalised, checked, registered.

A collection is a JSON document {scope, title, updated, layers: [...]}. Reading keeps the order of documents and layers as
`ord`, which breaks every tie later. Rules yield rows of issues (source, path, message) instead of errors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave import schema as S
from mapweave.functions import boxes, crs, nuts
from mapweave.functions.boxes import Box
from mapweave.functions.services import is_tiled

_OPTIONS = """STRUCT<layers: ARRAY<STRING>, styles: ARRAY<STRING>, format: STRING, infoFormats: ARRAY<STRING>, version: STRING, queryable: BOOLEAN,
transparent: BOOLEAN, tileSize: INT, time: STRING, maxWidth: INT, maxHeight: INT, extraParams: MAP<STRING, STRING>, layer: STRING, tileMatrixSet: STRING,
style: STRING, requestEncoding: STRING, urlTemplate: STRING, tileMatrixTemplate: STRING, dimensions: MAP<STRING, STRING>, scheme: STRING,
subdomains: ARRAY<STRING>, apiKeyParam: STRING, typeNames: ARRAY<STRING>, outputFormat: STRING, maxFeatures: INT, url: STRING, bands: ARRAY<INT>,
nodata: DOUBLE, resampling: STRING>"""
#: A raw layer. A system is one name or several, depending on the service, so it is read as text.
_RAW = f"""STRUCT<id: STRING, title: STRING, description: STRING, category: STRING, provider: STRUCT<name: STRING, url: STRING, shortName: STRING>,
country: STRING, nuts: STRING, regionName: STRING, bbox: ARRAY<DOUBLE>, coverage: ARRAY<ARRAY<DOUBLE>>, service: STRUCT<type: STRING, url: STRING, options: {_OPTIONS}>,
license: STRUCT<id: STRING, name: STRING, url: STRING, notes: STRING>, attribution: STRING, minZoom: DOUBLE, maxZoom: DOUBLE, resolutionMeters: DOUBLE,
temporal: STRUCT<start: STRING, end: STRING>, tags: ARRAY<STRING>, status: STRING, metadataUrl: STRING, documentationUrl: STRING, lastVerified: STRING>"""


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each document: source_file, doc_ord (the order of paths) and its text."""
    order = spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, p in enumerate(paths)], "source_file string, doc_ord int")
    texts = spark.read.text(paths, wholetext=True).select(F.col("value").alias("body"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))
    return texts.join(F.broadcast(order), "source_file")


def documents(spark: SparkSession, bodies: list[tuple[str, str]]) -> DataFrame:
    """The same from (source, JSON text) pairs in memory."""
    return spark.createDataFrame([(s, b, i) for i, (s, b) in enumerate(bodies)], "source_file string, body string, doc_ord int")


def _raw_layers(docs: DataFrame) -> DataFrame:
    """Documents exploded to raw layers, kept as text and as struct. Bodies that are no JSON give one row without a layer."""
    doc = F.from_json("body", "STRUCT<scope: STRING, title: STRING, updated: STRING, layers: ARRAY<STRING>>")
    out = docs.withColumn("doc", doc).select("source_file", "doc_ord", "body", F.col("doc.scope").alias("scope"), F.col("doc.title").alias("doc_title"), F.col("doc.updated").alias("updated"), F.posexplode_outer("doc.layers").alias("pos", "text"))
    return out.withColumn("raw", F.from_json("text", _RAW)).withColumn("keys", F.json_object_keys("text")).withColumn("crs_text", F.get_json_object("text", "$.service.options.crs"))


def _systems(text: Column) -> Column:
    many = F.from_json(text, "ARRAY<STRING>")
    return F.transform(F.when(F.startswith(F.trim(text), F.lit("[")), many).otherwise(F.when(text.isNotNull(), F.array(text))), crs.REGISTRY.normalise)


def _default(value: Column, otherwise) -> Column:
    return F.coalesce(value, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _service(raw: str) -> Column:
    o, kind = F.col(f"{raw}.service.options"), F.col(f"{raw}.service.type")
    none, systems = F.array().cast("array<string>"), _systems(F.col("crs_text"))
    one = _default(F.get(systems, F.lit(0)), "EPSG:3857")
    wms = F.struct(
        o["layers"].alias("layers"), _default(o["styles"], none).alias("styles"), _default(o["format"], "image/png").alias("format"), _default(o["infoFormats"], none).alias("infoFormats"),
        _default(systems, F.array(F.lit("EPSG:3857"))).alias("crs"), _default(o["version"], "1.3.0").alias("version"), _default(o["queryable"], False).alias("queryable"),
        _default(o["transparent"], True).alias("transparent"), _default(o["tileSize"], 256).alias("tileSize"), o["time"].alias("time"), o["maxWidth"].alias("maxWidth"), o["maxHeight"].alias("maxHeight"), o["extraParams"].alias("extraParams"),
    )
    wmts = F.struct(
        o["layer"].alias("layer"), o["tileMatrixSet"].alias("tileMatrixSet"), _default(o["style"], "default").alias("style"), _default(o["format"], "image/png").alias("format"), _default(o["version"], "1.0.0").alias("version"),
        _default(o["requestEncoding"], "KVP").alias("requestEncoding"), o["urlTemplate"].alias("urlTemplate"), one.alias("crs"), _default(o["tileSize"], 256).alias("tileSize"), o["tileMatrixTemplate"].alias("tileMatrixTemplate"),
        o["dimensions"].alias("dimensions"), _default(o["queryable"], False).alias("queryable"), _default(o["infoFormats"], none).alias("infoFormats"),
    )
    xyz = F.struct(o["urlTemplate"].alias("urlTemplate"), _default(o["scheme"], "xyz").alias("scheme"), _default(o["subdomains"], none).alias("subdomains"), _default(o["tileSize"], 256).alias("tileSize"), o["apiKeyParam"].alias("apiKeyParam"))
    wfs = F.struct(
        o["typeNames"].alias("typeNames"), _default(o["version"], "2.0.0").alias("version"), _default(o["outputFormat"], "application/json").alias("outputFormat"),
        _default(F.get(systems, F.lit(0)), "EPSG:4326").alias("crs"), o["maxFeatures"].alias("maxFeatures"), o["extraParams"].alias("extraParams"),
    )
    cog = F.struct(o["url"].alias("url"), o["bands"].alias("bands"), o["nodata"].alias("nodata"), _default(o["resampling"], "nearest").alias("resampling"), one.alias("crs"))
    return F.struct(kind.alias("type"), F.col(f"{raw}.service.url").alias("url"), *[F.when(kind == k.upper(), v).alias(k) for k, v in (("wms", wms), ("wmts", wmts), ("xyz", xyz), ("wfs", wfs), ("cog", cog))])


def normalise(docs: DataFrame) -> DataFrame:
    """Layer rows with all defaults, in document order."""
    rows = _raw_layers(docs).filter("raw IS NOT NULL")
    r = F.col("raw")
    plain = ["id", "title", "description", "category", "provider", "country", "nuts", "regionName"]
    late = ["license", "attribution"]
    out = rows.select(
        *[r[c].alias(c) for c in plain], Box.from_array(r["bbox"]).struct().alias("bbox"), F.transform(r["coverage"], lambda b: Box.from_array(b).struct()).alias("coverage"), _service("raw").alias("service"),
        *[r[c].alias(c) for c in late], _default(r["minZoom"], 0.0).cast("int").alias("minZoom"), _default(r["maxZoom"], 20.0).cast("int").alias("maxZoom"), r["resolutionMeters"].alias("resolutionMeters"),
        r["temporal"].alias("temporal"), _default(r["tags"], F.array().cast("array<string>")).alias("tags"), _default(r["status"], "active").alias("status"), r["metadataUrl"].alias("metadataUrl"),
        r["documentationUrl"].alias("documentationUrl"), r["lastVerified"].alias("lastVerified"), "source_file", "scope", (F.col("doc_ord") * F.lit(1_000_000).cast("long") + F.col("pos")).alias("ord"),
    )
    return derive(out)


def derive(layers: DataFrame) -> DataFrame:
    """Adds extents, area and whether the service has ready tiles; once, for all later queries."""
    out = layers.withColumn("extents", boxes.extents(F.col("bbox"), F.col("coverage")))
    return out.withColumn("area_km2", boxes.total_area(F.col("extents"))).withColumn("is_tiled", is_tiled())


def _rules(iso: list[str]) -> list[tuple[str, Column, Column]]:
    """(path, broken, message) over raw layers."""
    r = F.col("raw")
    o, kind = r["service"]["options"], r["service"]["type"]
    not_one_of = lambda c, values: ~F.coalesce(c.isin(*values), F.lit(False))
    short = lambda c, n: F.coalesce(F.length(c), F.lit(0)) < n
    whole = lambda c: F.coalesce((c != F.floor(c)) | ~c.between(0, 24), F.lit(False))
    low, high = _default(r["minZoom"], 0.0), _default(r["maxZoom"], 20.0)
    owner = nuts.to_iso(r["nuts"])
    web = lambda c: F.coalesce(~c.rlike("^https?://[^/]+"), F.lit(True))
    b = Box.from_array(r["bbox"])
    outside = lambda c: (F.get(c, F.lit(0)) < b.w) | (F.get(c, F.lit(1)) < b.s) | (F.get(c, F.lit(2)) > b.e) | (F.get(c, F.lit(3)) > b.n)
    unknown = F.filter(F.col("keys"), lambda k: ~k.isin(*S.LAYER_KEYS))
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) < 1
    text = lambda m: F.lit(m)
    return [
        ("id", not_one_of(r["id"].rlike("^[a-z0-9]+(?:[-.][a-z0-9]+)*$"), [True]) | ~F.length(r["id"]).between(3, 120), text("ids are lower case, separated by dots and dashes")),
        ("title", short(r["title"], 2), text("too short")), ("attribution", short(r["attribution"], 2), text("too short")), ("provider.name", short(r["provider"]["name"], 2), text("too short")),
        ("category", not_one_of(r["category"], S.CATEGORIES), text("unknown category")), ("status", r["status"].isNotNull() & not_one_of(r["status"], S.STATUSES), text("unknown status")),
        ("country", ~nuts.is_country(r["country"], iso), text("must be an ISO 3166-1 code or EU")), ("nuts", r["nuts"].isNotNull() & ~nuts.is_valid(r["nuts"]), text("must be a NUTS code of a known country")),
        ("nuts", r["nuts"].isNotNull() & (r["country"] != S.EU) & ~F.coalesce(owner == r["country"], F.lit(False)), F.concat(text("NUTS code "), r["nuts"], text(" belongs to "), F.coalesce(owner, text("an unknown country")), text(", not to "), r["country"])),
        ("minZoom", whole(r["minZoom"]), text("must be a whole number from 0 to 24")), ("maxZoom", whole(r["maxZoom"]), text("must be a whole number from 0 to 24")),
        ("minZoom", low > high, text("must not be above maxZoom")), ("bbox", ~boxes.is_valid(r["bbox"]), text("not a box of the world")),
        ("coverage", F.coalesce(F.size(r["coverage"]) == 0, F.lit(False)) | F.coalesce(F.exists(r["coverage"], lambda c: ~boxes.is_valid(c)), F.lit(False)), text("not boxes of the world")),
        ("coverage", F.coalesce(F.exists(r["coverage"], outside), F.lit(False)), text("reaches outside bbox")),
        ("license.id", not_one_of(r["license"]["id"], S.LICENSES), text("unknown licence")), ("license", (r["license"]["id"] == "custom") & short(r["license"]["name"], 1), text("custom licences need a name")),
        ("service.type", not_one_of(kind, S.SERVICES), text("unknown service")), ("service.url", web(r["service"]["url"]), text("must be http or https")),
        ("service.options.layers", (kind == "WMS") & empty(o["layers"]), text("must not be empty")),
        ("service.options.crs", (kind == "WMS") & F.coalesce(F.size(_systems(F.col("crs_text"))) == 0, F.lit(False)), text("must not be empty")),
        ("service.options.version", F.coalesce((kind == "WMS") & not_one_of(_default(o["version"], "1.3.0"), S.WMS_VERSIONS) | (kind == "WMTS") & (o["version"] != "1.0.0") | (kind == "WFS") & not_one_of(_default(o["version"], "2.0.0"), S.WFS_VERSIONS), F.lit(False)), text("unknown version")),
        ("service.options.tileSize", F.coalesce(~o["tileSize"].isin(256, 512), F.lit(False)), text("must be 256 or 512")),
        ("service.options.layer", (kind == "WMTS") & short(o["layer"], 1), text("missing")), ("service.options.tileMatrixSet", (kind == "WMTS") & short(o["tileMatrixSet"], 1), text("missing")),
        ("service.options.urlTemplate", (kind == "XYZ") & short(o["urlTemplate"], 1), text("missing")), ("service.options.typeNames", (kind == "WFS") & empty(o["typeNames"]), text("must not be empty")),
        ("service.options.maxFeatures", F.coalesce(~o["maxFeatures"].between(1, 100_000), F.lit(False)), text("must be 1 to 100000")),
        ("service.options.url", (kind == "COG") & web(o["url"]), text("must be http or https")),
        ("service.options.format", F.coalesce(kind.isin("WMS", "WMTS") & ~_default(o["format"], "image/png").rlike(r"(?i)^image/[a-z0-9+.\-]+(;\s*[a-z0-9\-]+=[a-z0-9\-]+)?$"), F.lit(False)), text("must be an image type")),
        ("resolutionMeters", F.coalesce(r["resolutionMeters"] <= 0, F.lit(False)), text("must be positive")),
        ("temporal", F.coalesce(~r["temporal"]["start"].rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False)) | F.coalesce(~r["temporal"]["end"].rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False)), text("use YYYY, YYYY-MM or YYYY-MM-DD")),
        ("lastVerified", F.coalesce(~r["lastVerified"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), text("use YYYY-MM-DD")),
        ("", F.size(unknown) > 0, F.concat(text("unknown key "), F.array_join(unknown, ", "))),
    ]


def issues(docs: DataFrame) -> DataFrame:
    """Broken rules: doc_ord, source, path, message."""
    rows = _raw_layers(docs)
    rules = _rules(nuts.iso_countries(docs.sparkSession))
    named = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.concat(F.lit("layers."), F.col("pos").cast("string"), F.lit("." + path if path else "")).alias("path"), F.coalesce(message, F.lit("missing")).alias("message"))) for path, bad, message in rules]
    of_layers = rows.filter("pos IS NOT NULL").select("doc_ord", "source_file", F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("i"))
    whole = F.array(
        F.when(F.coalesce(F.length("scope"), F.lit(0)) < 2, F.struct(F.lit("scope").alias("path"), F.lit("too short").alias("message"))),
        F.when(F.coalesce(F.length("doc_title"), F.lit(0)) < 2, F.struct(F.lit("title").alias("path"), F.lit("too short").alias("message"))),
        F.when(F.get_json_object("body", "$.layers").isNull(), F.struct(F.lit("layers").alias("path"), F.lit("missing").alias("message"))),
    )
    of_docs = rows.filter("pos IS NULL OR pos = 0").select("doc_ord", "source_file", F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("i"))
    return of_layers.unionByName(of_docs).select("doc_ord", F.col("source_file").alias("source"), "i.path", "i.message")


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers and issues. A document with any issue is left out as a whole; of layers with one id the first in order stays."""
    found = issues(docs)
    sound = docs.join(found.select("doc_ord").distinct(), "doc_ord", "left_anti")
    ranked = normalise(sound).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("ord")))
    again = ranked.filter("nth > 1").select(F.floor(F.col("ord") / 1_000_000).cast("int").alias("doc_ord"), F.col("source_file").alias("source"), F.concat(F.lit("layers."), "id").alias("path"), F.concat(F.lit('Duplicate layer id "'), "id", F.lit('"')).alias("message"))
    return ranked.filter("nth = 1").drop("nth"), found.unionByName(again)


def build_strict(docs: DataFrame) -> DataFrame:
    """Layers; raises if there are issues, naming the first five."""
    layers, found = build(docs)
    first = found.orderBy("doc_ord", "path", "message").limit(6).collect()
    if first:
        raise ValueError(f"the catalogue is not valid ({found.count()} issues): " + "; ".join(f"{r.source}: {r.path} - {r.message}" for r in first[:5]))
    return layers


def register(layers: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue with the new documents' layers behind it, those accepted, and the issues. Ids that are taken are rejected."""
    new, found = build(docs)
    after = F.lit((layers.agg(F.max("ord")).first()[0] or 0) + 1_000_000)
    taken = new.join(layers.select("id"), "id", "left_semi").select(F.floor(F.col("ord") / 1_000_000).cast("int").alias("doc_ord"), F.col("source_file").alias("source"), F.concat(F.lit("layers."), "id").alias("path"), F.concat(F.lit('Duplicate layer id "'), "id", F.lit('"')).alias("message"))
    accepted = new.join(layers.select("id"), "id", "left_anti").withColumn("ord", F.col("ord") + after)
    return layers.unionByName(accepted), accepted, found.unionByName(taken)


def write(docs: DataFrame, path: str) -> None:
    """The batch job: checks, normalises and writes the catalogue as Parquet, once; nothing is written if a rule is broken."""
    build_strict(docs).write.mode("overwrite").parquet(path)


def json_schema() -> str:
    """JSON Schema of a collection document: the types of the record and the rules that a document must keep."""
    from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StructType

    def of(kind) -> dict:
        if isinstance(kind, StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind}, "additionalProperties": False}
        if isinstance(kind, ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, MapType):
            return {"type": "object", "additionalProperties": of(kind.valueType)}
        return {"type": "boolean" if isinstance(kind, BooleanType) else ("integer" if kind.typeName() in ("integer", "long") else "number") if isinstance(kind, NumericType) else "string"}

    record = {f.name: of(f.dataType) for f in StructType.fromDDL(S.LAYER) if f.name in S.LAYER_KEYS}
    options, url = record["service"]["properties"], {"type": "string", "pattern": "^https?://"}
    box = {"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4}
    some = {"type": "array", "items": {"type": "string", "minLength": 1}, "minItems": 1}
    options["wms"]["properties"] |= {"layers": some, "version": {"enum": S.WMS_VERSIONS}}
    options["wfs"]["properties"] |= {"typeNames": some, "version": {"enum": S.WFS_VERSIONS}}
    needed = {"wms": ["layers"], "wmts": ["layer", "tileMatrixSet"], "xyz": ["urlTemplate"], "wfs": ["typeNames"], "cog": []}
    record["service"] = {"oneOf": [
        {"type": "object", "properties": {"type": {"const": t}, "url": url, "options": options[t.lower()] | {"required": needed[t.lower()]}}, "required": ["type", "url"]} for t in S.SERVICES
    ]}
    zoom = {"type": "integer", "minimum": 0, "maximum": 24}
    record |= {"category": {"enum": S.CATEGORIES}, "status": {"enum": S.STATUSES}, "bbox": box, "coverage": {"type": "array", "items": box, "minItems": 1}, "minZoom": zoom, "maxZoom": zoom}
    record["license"]["properties"]["id"] = {"enum": S.LICENSES}
    record["id"] |= {"pattern": "^[a-z0-9]+(?:[-.][a-z0-9]+)*$", "minLength": 3, "maxLength": 120}
    year, day = "^\\d{4}(-\\d{2}(-\\d{2})?)?$", "^\\d{4}-\\d{2}-\\d{2}$"
    record["temporal"]["properties"] = {k: {"type": "string", "pattern": year} for k in ("start", "end")}
    record["lastVerified"] |= {"pattern": day}
    record["country"] |= {"pattern": "^[A-Z]{2}$"}
    layer = {"type": "object", "properties": record, "additionalProperties": False, "required": ["id", "title", "category", "provider", "country", "bbox", "service", "license", "attribution"]}
    text = {"type": "string", "minLength": 2}
    whole = {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {"scope": text, "title": text, "layers": {"type": "array", "items": layer}}, "required": ["scope", "title", "layers"]}
    return json.dumps(whole, sort_keys=True)
