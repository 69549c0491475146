"""Which layers win ground that belongs to another country or region."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.boxes import Box
from mapweave.operators.spatial import paired

STEPS = 12


#: Layers of equal extents that are taken as one when pairs are looked for.
GROUP = 200


def _groups(layers: DataFrame) -> DataFrame:
    """A row for the layers of the same box and extents, GROUP of them or so: first (the least ord), bbox, extents, layers."""
    size = F.count("*").over(Window.partitionBy("bbox", "extents"))
    split = F.pmod(F.xxhash64("ord"), F.ceil(F.col("__n") / GROUP))
    rows = layers.filter("ord IS NOT NULL").select("ord", "id", "country", "nuts", F.col("coverage").isNotNull().alias("narrowed"), "bbox", "extents").withColumn("__n", size).withColumn("__split", split)
    return rows.groupBy("bbox", "extents", "__split").agg(F.min("ord").alias("first"), F.collect_list(F.struct("ord", "id", "country", "nuts", "narrowed")).alias("layers")).drop("__split")


def _held(extents: pa.Array, lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """For each row its grid: whether a box of its list holds the point."""
    held, starts = np.zeros((len(lng), lng.shape[1], lat.shape[1]), bool), extents.offsets.to_numpy()
    sides, counts = [f.to_numpy(zero_copy_only=False) for f in extents.values.flatten()], np.diff(starts)
    for k in range(counts.max(initial=0)):
        have = np.flatnonzero(counts > k)
        w, s, e, n = (f[starts[have] + k][:, None] for f in sides)
        x, y = lng[have], lat[have]
        columns = np.where(w <= e, (x >= w) & (x <= e), (x >= w) | (x <= e))
        held[have] |= columns[:, :, None] & ((y >= s) & (y <= n))[:, None, :]
    return held


def _common_points(ea: Column, eb: Column, box: Box, steps: int) -> Column:
    """Points of the grid over box that extents of both lists hold.

    As columns, the grid's points are so many calls of lambdas that they cost a hundred times the rest; so batches are counted in Python.
    """
    @F.arrow_udf("int")
    def counted(a: pa.Array, b: pa.Array, w: pa.Array, s: pa.Array, e: pa.Array, n: pa.Array) -> pa.Array:
        w, s, e, n = (v.to_numpy(zero_copy_only=False)[:, None] for v in (w, s, e, n))
        i = np.arange(steps + 1.0)
        lng, lat = w + (e - w) * i / steps, s + (n - s) * i / steps
        out = [(_held(a[k : k + 2_000], lng[k : k + 2_000], lat[k : k + 2_000]) & _held(b[k : k + 2_000], lng[k : k + 2_000], lat[k : k + 2_000])).sum((1, 2)) for k in range(0, len(w), 2_000)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32), pa.int32())

    return counted(ea, eb, box.w, box.s, box.e, box.n)


def contested(layers: DataFrame, steps: int = STEPS) -> DataFrame:
    """For each overlapping pair of different scopes: the smaller layer (winner), the larger one (loser), and the share of a grid over their overlap that both cover.

    Layers of the same extents share their grids with every other, so these are counted once for all of them. Groups meet in a grid
    of cells and carry their layers along; pairs are made last and go nowhere.
    """
    met = paired(_groups(layers), "first", "bbox", area=True, itself=True)
    p, q = Box.of("bbox"), Box.of("bbox_b")
    shared = Box(F.greatest(p.w, q.w), F.greatest(p.s, q.s), F.least(p.e, q.e), F.least(p.n, q.n))
    counted = _common_points(F.col("extents"), F.col("extents_b"), shared, steps)
    # of an outer list of one, so that it is counted once and not again for the filter
    met = met.select("*", F.explode_outer(F.array(counted)).alias("contested")).filter("contested > 0").withColumn("contested_share", F.round(F.col("contested") / ((steps + 1) ** 2), 3))
    met = met.select("first", "first_b", "contested", "contested_share", p.area_km2().alias("hull"), q.area_km2().alias("hull_b"), "layers", "layers_b")
    met = met.select("*", F.explode("layers").alias("a")).drop("layers").select("*", F.explode("layers_b").alias("b")).drop("layers_b")
    other = ~(F.col("a.country").eqNullSafe(F.col("b.country")) & F.col("a.nuts").eqNullSafe(F.col("b.nuts")))
    met = met.filter(((F.col("first") != F.col("first_b")) | (F.col("a.ord") < F.col("b.ord"))) & other)
    first_is_small = (F.col("hull") < F.col("hull_b")) | ((F.col("hull") == F.col("hull_b")) & (F.col("a.ord") > F.col("b.ord")))  # of equal ones the later
    pick = lambda c, small: F.when(first_is_small, F.col(f"a.{c}" if small else f"b.{c}")).otherwise(F.col(f"b.{c}" if small else f"a.{c}"))
    return met.select(
        pick("id", True).alias("winner"), pick("id", False).alias("loser"), F.coalesce(pick("nuts", True), pick("country", True)).alias("winner_scope"), F.coalesce(pick("nuts", False), pick("country", False)).alias("loser_scope"),
        (F.col("a.country") != F.col("b.country")).alias("cross_border"), pick("narrowed", True).alias("narrowed"), "contested", "contested_share",
    )


def in_order(findings: DataFrame) -> DataFrame:
    """The largest share first."""
    return findings.orderBy(F.desc("contested_share"), "winner", "loser")


def by_winner(findings: DataFrame) -> DataFrame:
    return findings.groupBy("winner").agg(F.count("*").alias("conflicts"), F.count_if("cross_border").alias("cross_border"), F.bool_or("narrowed").alias("narrowed"))
