"""Tiles as pixels: finding the flat fill that services draw where they have no data, and joining four tiles to one.

A tile is (size, rgba: binary, four bytes a pixel). The fill is an iterative flood from the border, which columns can't
express; NumPy does it a tile at a time in Arrow batches. Encoded images need a codec that this environment lacks, so
callers pass decoded pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Side of the reduced tile that settles most cases; shares above which a tile is empty, or is trimmed.
PROBE, EMPTY, TRIM = 64, 0.9, 0.02


def flat(rgba: np.ndarray) -> np.ndarray:
    """Transparent, near white or near black pixels of an array (..., 4)."""
    r, g, b = (rgba[..., i].astype(int) for i in range(3))
    grey = (np.abs(r - g) < 6) & (np.abs(g - b) < 6) & (np.abs(r - b) < 6)
    return (rgba[..., 3] < 16) | (grey & ((np.abs(r - 255) < 10) | (np.abs(r) < 10)))


def collar(mask: np.ndarray) -> np.ndarray:
    """Flat pixels joined to the border, over edges. Grows by whole runs of rows and columns until nothing changes."""
    seen = np.zeros_like(mask)
    seen[[0, -1]], seen[:, [0, -1]] = mask[[0, -1]], mask[:, [0, -1]]
    while True:
        before = seen.sum()
        for axis in (0, 1):
            for turn in (slice(None), slice(None, None, -1)):
                m, s = (np.moveaxis(a, axis, 0)[turn] for a in (mask, seen))
                for i in range(1, len(m)):
                    s[i] |= s[i - 1] & m[i]
        if seen.sum() == before:
            return seen


def inspect(rgba: np.ndarray) -> tuple[str, float, np.ndarray | None]:
    """keep, trim or empty; the share of the collar; for trim the tile with the collar made transparent."""
    size = len(rgba)
    at = (np.arange(PROBE) * size // PROBE) if size > PROBE else np.arange(size)
    probe = flat(rgba[np.ix_(at, at)])
    if not (probe[[0, -1]].any() or probe[:, [0, -1]].any()):
        return "keep", 0.0, None
    share = collar(probe).mean()
    if share < TRIM:
        return "keep", float(share), None
    if share >= EMPTY:
        return "empty", float(share), None
    mask = collar(flat(rgba))
    share = mask.mean()
    if share >= EMPTY or share < TRIM:
        return ("empty" if share >= EMPTY else "keep"), float(share), None
    out = rgba.copy()
    out[mask, 3] = 0
    return "trim", float(share), out


def verdicts(tiles: DataFrame, key: str = "tile") -> DataFrame:
    """Rows key, verdict, share, rgba (trimmed tiles only). Tiles whose bytes don't fit their size, and null ones, are errors in the verdict."""

    def each(batches):
        for batch in batches:
            rows = []
            for size, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not size or raw is None or len(raw) != 4 * size * size:
                    rows.append(("invalid", None, None))
                    continue
                verdict, share, out = inspect(np.frombuffer(raw, np.uint8).reshape(size, size, 4))
                rows.append((verdict, share, None if out is None else out.tobytes()))
            v, s, o = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.string()), pa.array(s, pa.float64()), pa.array(o, pa.binary())], names=[key, "verdict", "share", "rgba"])

    kind = dict(tiles.dtypes)[key]
    return tiles.select(key, "size", "rgba").mapInArrow(each, f"{key} {kind}, verdict string, share double, rgba binary")


def stitch(children: DataFrame, key: str = "tile") -> DataFrame:
    """Children (key, quadrant 0 to 3, size, rgba, bytes) joined to one tile of twice the size; null if one is missing. bytes: their weight."""
    kind = dict(children.dtypes)[key]

    def join(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist() if r["rgba"] is not None), key=lambda r: r["quadrant"])
        name = table.column(key)[0].as_py()
        whole = [r["quadrant"] for r in rows] == [0, 1, 2, 3] and len({r["size"] for r in rows}) == 1
        out = size = weight = None
        if whole:
            part = [np.frombuffer(r["rgba"], np.uint8).reshape(r["size"], r["size"], 4) for r in rows]
            out = np.vstack([np.hstack(part[:2]), np.hstack(part[2:])]).tobytes()
            size, weight = 2 * rows[0]["size"], sum(r["bytes"] for r in rows)
        return pa.table({key: pa.array([name], table.schema.field(key).type), "size": pa.array([size], pa.int32()), "rgba": pa.array([out], pa.binary()), "bytes": pa.array([weight], pa.int64())})

    return children.select(key, "quadrant", "size", "rgba", "bytes").groupBy(key).applyInArrow(join, f"{key} {kind}, size int, rgba binary, bytes long")
