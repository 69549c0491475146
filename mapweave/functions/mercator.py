"""Spherical Mercator and the tile pyramid as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.boxes import Box
from mapweave.schema import MAX_LATITUDE

RADIUS = 6378137.0
HALF_WORLD = math.pi * RADIUS


def _clamped(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))


def project(lng: Column, lat: Column) -> tuple[Column, Column]:
    return RADIUS * lng * (math.pi / 180), RADIUS * F.atanh(F.sin(_clamped(lat) * (math.pi / 180)))


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    return x / RADIUS * (180 / math.pi), F.asin(F.tanh(y / RADIUS)) * (180 / math.pi)


def project_box(b: Box) -> Box:
    return Box(*project(b.w, b.s), *project(b.e, b.n))


def unproject_box(b: Box) -> Box:
    return Box(*unproject(b.w, b.s), *unproject(b.e, b.n))


def meters_per_pixel(zoom: Column, tile: int = 256) -> Column:
    return 2 * HALF_WORLD / (tile * F.pow(F.lit(2.0), zoom))


def zoom_of_resolution(resolution: Column, tile: int = 256) -> Column:
    return F.log2(2 * HALF_WORLD / (tile * resolution))


def meters_per_pixel_at(zoom: Column, lat: Column, tile: int = 256) -> Column:
    return meters_per_pixel(zoom, tile) * F.cos(_clamped(lat) * (math.pi / 180))


def zoom_of_resolution_at(resolution: Column, lat: Column, tile: int = 256) -> Column:
    """Zoom at which data of a resolution are drawn pixel for pixel at a latitude."""
    return zoom_of_resolution(resolution, tile) + F.log2(F.cos(_clamped(lat) * (math.pi / 180)))


def tile_box_projected(x: Column, y: Column, z: Column) -> Box:
    size = 2 * HALF_WORLD / F.pow(F.lit(2.0), z)
    w, n = x * size - HALF_WORLD, HALF_WORLD - y * size
    return Box(w, n - size, w + size, n)


def tile_box(x: Column, y: Column, z: Column) -> Box:
    return unproject_box(tile_box_projected(x, y, z))


def tile_of(lng: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    scale = F.pow(F.lit(2.0), z)
    sin = F.sin(_clamped(lat) * (math.pi / 180))
    x = F.floor((lng + 180) / 360 * scale)
    y = F.floor((0.5 - F.ln((1 + sin) / (1 - sin)) / (4 * math.pi)) * scale)
    last = (scale - 1).cast("long")
    return tuple(F.greatest(F.lit(0).cast("long"), F.least(v, last)) for v in (x, y))


def map_zoom(z: Column, tile: int = 512) -> Column:
    """Tiles of 512 pixels show the detail of the next zoom."""
    return z + 1 if tile == 512 else z


def block_key(x: Column, y: Column, z: Column) -> Column:
    """A block of four by four tiles."""
    return F.concat_ws("/", z, F.shiftright(x, 2), F.shiftright(y, 2))


def area_key(x: Column, y: Column, z: Column, at: int = 12) -> Column:
    """The tile of zoom `at` that holds the tile, or its first one there."""
    def moved(v: Column) -> Column:
        size = F.pow(F.lit(2.0), F.abs(z - at)).cast("long")
        return F.when(z <= at, v * size).otherwise(F.floor(v / size))

    return F.concat_ws("/", moved(x), moved(y))
