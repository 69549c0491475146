"""The layer record and the fixed values that its fields may take."""

from __future__ import annotations

BOX = "STRUCT<min_lng: DOUBLE, min_lat: DOUBLE, max_lng: DOUBLE, max_lat: DOUBLE>"

_SERVICE = f"""STRUCT<type: STRING, url: STRING,
  wms: STRUCT<layers: ARRAY<STRING>, styles: ARRAY<STRING>, format: STRING, infoFormats: ARRAY<STRING>, crs: ARRAY<STRING>, version: STRING,
    queryable: BOOLEAN, transparent: BOOLEAN, tileSize: INT, time: STRING, maxWidth: INT, maxHeight: INT, extraParams: MAP<STRING, STRING>>,
  wmts: STRUCT<layer: STRING, tileMatrixSet: STRING, style: STRING, format: STRING, version: STRING, requestEncoding: STRING, urlTemplate: STRING,
    crs: STRING, tileSize: INT, tileMatrixTemplate: STRING, dimensions: MAP<STRING, STRING>, queryable: BOOLEAN, infoFormats: ARRAY<STRING>>,
  xyz: STRUCT<urlTemplate: STRING, scheme: STRING, subdomains: ARRAY<STRING>, tileSize: INT, apiKeyParam: STRING>,
  wfs: STRUCT<typeNames: ARRAY<STRING>, version: STRING, outputFormat: STRING, crs: STRING, maxFeatures: INT, extraParams: MAP<STRING, STRING>>,
  cog: STRUCT<url: STRING, bands: ARRAY<INT>, nodata: DOUBLE, resampling: STRING, crs: STRING>>"""

#: One row a layer, with the columns that the engine adds behind those of the record.
LAYER = f"""id STRING, title STRING, description STRING, category STRING, provider STRUCT<name: STRING, url: STRING, shortName: STRING>,
country STRING, nuts STRING, regionName STRING, bbox {BOX}, coverage ARRAY<{BOX}>, service {_SERVICE},
license STRUCT<id: STRING, name: STRING, url: STRING, notes: STRING>, attribution STRING, minZoom INT, maxZoom INT, resolutionMeters DOUBLE,
temporal STRUCT<start: STRING, end: STRING>, tags ARRAY<STRING>, status STRING, metadataUrl STRING, documentationUrl STRING, lastVerified STRING,
source_file STRING, scope STRING, ord BIGINT, extents ARRAY<{BOX}>, area_km2 DOUBLE, is_tiled BOOLEAN"""

# What the enumerated fields may hold, in the order of the record's definition.
CATEGORIES = ["orthophoto", "satellite", "cadastre", "elevation", "land_use", "custom"]
SERVICES = ["WMS", "WMTS", "XYZ", "WFS", "COG"]
WMS_VERSIONS = ["1.1.0", "1.1.1", "1.3.0"]
WFS_VERSIONS = ["1.0.0", "1.1.0", "2.0.0"]
STATUSES = ["active", "experimental", "deprecated", "offline"]
LICENSES = [
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-3.0", "CC-BY-2.5", "CC0-1.0", "IODL-2.0", "IODL-1.0", "ODbL-1.0", "etalab-2.0", "etalab-1.0",
    "dl-de-by-2.0", "dl-de-zero-2.0", "OGL-3.0", "NLOD-2.0", "copernicus-free", "inspire-open", "proprietary", "custom", "unknown",
]
LAYER_KEYS = [
    "id", "title", "description", "category", "provider", "country", "nuts", "regionName", "bbox", "coverage", "service", "license", "attribution",
    "minZoom", "maxZoom", "resolutionMeters", "temporal", "tags", "status", "metadataUrl", "documentationUrl", "lastVerified",
]

#: The pseudo-country of pan-European data.
EU = "EU"
WORLD = (-180.0, -90.0, 180.0, 90.0)
MAX_LATITUDE = 85.0511287798066
MERCATOR_WORLD = (-180.0, -MAX_LATITUDE, 180.0, MAX_LATITUDE)
# Formats of images and of feature information that services advertise.
IMAGE_FORMATS = ["image/png", "image/png8", "image/png; mode=8bit", "image/jpeg", "image/webp", "image/gif", "image/tiff", "image/vnd.jpeg-png"]
INFO_FORMATS = ["application/json", "application/geo+json", "application/vnd.ogc.gml", "application/vnd.ogc.gml/3.1.1", "text/xml", "text/html", "text/plain"]

#: Error codes of sweeps and parsers.
PARSE_ERROR, SERVICE_EXCEPTION, UNSUPPORTED, UNAVAILABLE, UNKNOWN = "CAPABILITIES_PARSE_ERROR", "SERVICE_EXCEPTION", "UNSUPPORTED_SERVICE", "ENDPOINT_UNAVAILABLE", "UNKNOWN_ERROR"


class MapError(Exception):
    """An error with one of the codes above."""

    def __init__(self, code: str, message: str, status: int | None = None):
        super().__init__(message)
        self.code, self.status = code, status
