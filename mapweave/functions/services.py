"""What a layer's service can do, as columns over layer rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.urls import supports_mercator


def is_type(kind: str) -> Column:
    return F.col("service.type") == kind


def is_queryable() -> Column:
    by_flag = F.coalesce(F.when(is_type("WMS"), F.col("service.wms.queryable")).when(is_type("WMTS"), F.col("service.wmts.queryable")), F.lit(False))
    return is_type("WFS") | by_flag


def info_formats() -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(is_type("WMS"), F.col("service.wms.infoFormats")).when(is_type("WMTS"), F.col("service.wmts.infoFormats")).when(is_type("WFS"), F.array("service.wfs.outputFormat")), none)


def is_raster() -> Column:
    return ~is_type("WFS")


def is_tiled() -> Column:
    return F.col("service.type").isin("WMTS", "XYZ")


def is_visible_at(zoom: Column) -> Column:
    return zoom.between(F.col("minZoom"), F.col("maxZoom"))


def needs_reprojection() -> Column:
    return is_type("WMS") & ~supports_mercator(F.col("service.wms.crs"))


def can_stitch(tile: int = 512) -> Column:
    native = F.when(is_type("WMTS"), F.col("service.wmts.tileSize")).when(is_type("XYZ"), F.col("service.xyz.tileSize"))
    return F.coalesce(is_tiled() & (native * 2 == tile), F.lit(False))


def click_problem() -> Column:
    """Why a layer can't be asked for feature information; null if it can."""
    return (
        F.when(~is_type("WMS"), F.concat(F.lit("feature information needs a WMS layer; "), F.col("id"), F.lit(" is a "), F.col("service.type"), F.lit(" service")))
        .when(~F.coalesce("service.wms.queryable", F.lit(False)), F.concat(F.col("id"), F.lit(" is not queryable")))
    )
