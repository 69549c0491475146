"""Outlines of countries from GeoJSON, coarse enough to be a small table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCALE = 100


def from_geojson(features: DataFrame, iso: str = "iso", geometry: str = "geometry", scale: int = SCALE) -> DataFrame:
    """features (iso, geometry as GeoJSON text) to outline rows iso, shape, ring, points. Points are put on a grid of 1/scale degrees, repeated ones dropped, and rings of under four points left out (with their shape, if the outer one)."""
    multi = F.get_json_object(geometry, "$.type") == "MultiPolygon"
    text = F.get_json_object(geometry, "$.coordinates")
    polygons = F.when(multi, F.from_json(text, "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")).otherwise(F.array(F.from_json(text, "ARRAY<ARRAY<ARRAY<DOUBLE>>>")))
    order = features.withColumn("__shape", F.monotonically_increasing_id() * 100_000)
    rings = order.select(F.col(iso).alias("iso"), "__shape", F.posexplode(polygons).alias("p", "polygon")).select("iso", (F.col("__shape") + F.col("p")).alias("shape"), F.posexplode("polygon").alias("ring", "raw"))
    rings = rings.select("iso", "shape", "ring", quantised(F.col("raw"), scale).alias("points")).filter(F.size("points") >= 4)
    return rings.join(rings.filter("ring = 0").select("shape"), "shape", "left_semi").select("iso", "shape", "ring", "points")


def quantised(ring: Column, scale: int = SCALE) -> Column:
    on_grid = F.transform(ring, lambda p: F.struct((F.floor(F.get(p, F.lit(0)) * scale + 0.5) / scale).alias("lng"), (F.floor(F.get(p, F.lit(1)) * scale + 0.5) / scale).alias("lat")))
    return F.filter(on_grid, lambda p, i: (i == 0) | (p != F.get(on_grid, i - 1)))


def decode_ring(text: str, alphabet: str, scale: int = SCALE) -> list[dict]:
    """Points of a ring written as zigzag differences in five-bit groups."""
    value_of = {c: i for i, c in enumerate(alphabet)}
    numbers, value, shift = [], 0, 0
    for c in text:
        v = value_of.get(c, 0)
        value |= (v & 31) << shift
        shift += 5
        if not v & 32:
            numbers.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    x = y = 0
    out = []
    for dx, dy in zip(numbers[::2], numbers[1::2], strict=False):
        x, y = x + dx, y + dy
        out.append({"lng": x / scale, "lat": y / scale})
    return out


def encode_ring(points: list[tuple[float, float]], alphabet: str, scale: int = SCALE) -> str:
    """The inverse of decode_ring."""
    out, before = [], (0, 0)
    for p in points:
        now = (round(p[0] * scale), round(p[1] * scale))
        for d in (now[0] - before[0], now[1] - before[1]):
            z = -d * 2 + 1 if d < 0 else d * 2
            while True:
                out.append(alphabet[z & 31 | (32 if z > 31 else 0)])
                z >>= 5
                if not z:
                    break
        before = now
    return "".join(out)


def decoded(encoded: DataFrame, alphabet: str, scale: int = SCALE) -> DataFrame:
    """encoded (iso, shape, ring, text) to outline rows."""
    kind = StructType.fromDDL("points ARRAY<STRUCT<lng: DOUBLE, lat: DOUBLE>>")["points"].dataType

    @F.arrow_udf(kind)
    def points(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decode_ring(t, alphabet, scale) for t in texts.to_pylist()], pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())])))

    return encoded.select("iso", "shape", "ring", points(F.col("text")).alias("points"))
