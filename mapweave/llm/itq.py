"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned (on a bounded sample) that make the signs of rotated vectors balanced codes of 64 bits with little
loss. Every vector is coded under several of them; each code is cut into parts, and vectors that agree in a part meet in
a bucket of one of the rotations * parts tables. Pairs there whose codes differ in NEAR bits at most are candidates, and
their cosine is taken from the original vectors in double precision: no link below the limit is ever returned.

The width of a part grows with the logarithm of the number of vectors, so that buckets of unrelated ones stay small at any size;
longer parts agree more seldom, so there are more tables, for the same share of links found (see `Shape`).

Equal vectors are one node with a weight. Buckets first pass with codes alone; only members with a near code get their
vectors, so unrelated vectors cost no more than that. In both passes members of large buckets are dealt out in blocks, a task
for each pair of blocks. A pair that meets in several tables counts in the first. From a bucket come, for each member, the weight of its
partners and one link to its component there, never the pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths don't
link. Repeated rows are links of each other; ties need no care; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.blocks import in_blocks
from mapweave.llm.common import group_numbers, map_arrow, whole_groups, written
from mapweave.llm.components import connected_components, local_components

#: Differing bits of candidates, vectors learned from at most, rounds of learning.
NEAR, SAMPLE, ROUNDS = 16, 20_000, 30
#: Members of a bucket to a block, in the pass over vectors and in that over codes.
BLOCK, CODE_BLOCK = 1024, 8192
BITS = 64


class Shape(NamedTuple):
    """Rotations, parts of each code, bits of a part."""

    rotations: int
    parts: int
    width: int

    @staticmethod
    def of(vectors: int) -> Shape:
        """About 256 unrelated vectors to a bucket, 16 bits at least. Two vectors of cosine 0.95 agree in a bit with a chance of 1 - acos(0.95) / pi;
        there are so many tables that they meet in some as often as in 20 tables of 16 bits."""
        width = min(32, max(16, math.ceil(math.log2(max(vectors, 1) / 256))))
        parts = BITS // width
        agree = 1 - math.acos(0.95) / math.pi
        return Shape(math.ceil(20 * agree ** (16 - width) / parts), parts, width)


def _random_rotation(n: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


def learn(sample: np.ndarray, rotations: int) -> list[np.ndarray]:
    """For each rotation the matrix that turns vectors into 64 numbers whose signs are the code. sample: rows of one length."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d = sample.shape[1]
    c = min(d, BITS)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, :c]
    flat, out = unit @ axes, []
    for seed in range(rotations * -(-BITS // c)):
        turn = _random_rotation(c, seed)
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out.append(axes @ turn)
    each = -(-BITS // c)  # short vectors need several rotations for 64 bits
    return [np.hstack(out[i * each : (i + 1) * each])[:, :BITS] for i in range(rotations)]


@cache
def _unlearned(d: int, rotations: int) -> list[np.ndarray]:
    """For vectors of a length that the sample lacks."""
    return learn(np.random.default_rng(d).normal(size=(4 * d + 8, d)), rotations)


def codes(vectors: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """(rows, rotations) of 64-bit codes."""
    out = [np.packbits(vectors @ t >= 0, axis=1).view(">u8")[:, 0] for t in turns]
    return np.stack(out, axis=1).astype(np.uint64)


def _parts(code: np.ndarray, shape: Shape) -> np.ndarray:
    """(rows, tables) of the parts of codes (rows, rotations), in the order of the tables."""
    cut = [(code >> np.uint64(shape.width * p)) & np.uint64((1 << shape.width) - 1) for p in range(shape.parts)]
    return np.stack(cut, axis=2).reshape(len(code), -1).astype(np.int64)


def near_members(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which members have another one in their group whose code is near. group: sorted numbers."""
    found = np.zeros(len(code), bool)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    for step in range(1, min(int(sizes.max(initial=0)), 64)):
        i = np.flatnonzero(group[step:] == group[:-step])
        i = i[np.bitwise_count(code[i] ^ code[i + step]) <= NEAR]
        found[i] = found[i + step] = True
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own = code[s : s + n]
        for k in range(0, n, BLOCK):
            near = np.bitwise_count(own[k : k + BLOCK, None] ^ own[None, :]) <= NEAR
            found[s + k : s + min(k + BLOCK, n)] = near.sum(axis=1) > 1  # one is the member itself
    return found


def verify(t: int, left: tuple, right: tuple, same: bool, least: float, parts: int) -> np.ndarray:
    """Which of left x right are links first met in table t. left, right: (unit vectors, codes, parts)."""
    (x, cx, px), (y, cy, py) = left, right
    met = np.zeros((len(x), len(y)), bool)
    for r in range(t // parts + 1):
        upto = min(t - r * parts, parts)  # tables of rotation r that come before t
        agree = np.zeros_like(met)
        for p in range(upto):
            agree |= px[:, None, r * parts + p] == py[None, :, r * parts + p]
        near = np.bitwise_count(cx[:, None, r] ^ cy[None, :, r]) <= NEAR
        if r == t // parts:
            out = near & ~met & ~agree
        else:
            met |= agree & near
    out &= x @ y.T >= least
    if same:
        out &= ~np.eye(len(x), dtype=bool)
    return out


def links(dealt: DataFrame, least: float, shape: Shape) -> DataFrame:
    """dealt: t, k, i, j (a pair of blocks of a bucket), block, node, weight, vec, codes. Gives node, root, weight of partners."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, k, i, j, block, node, weight, vec, code in whole_groups(batches, 4):
            number = group_numbers([t, k, i, j])
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            rows = []
            for s, e in zip(starts, [*starts[1:], len(number)], strict=True):
                if e - s < 2:
                    continue
                size = np.fromiter(map(len, vec[s:e]), np.int64, e - s)
                for d in np.unique(size):
                    at = s + np.flatnonzero(size == d)
                    x = np.stack(vec[at])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    c = np.stack(code[at]).view(np.uint64)
                    sides = [np.flatnonzero(block[at] == b) for b in ((i[s],) if i[s] == j[s] else (i[s], j[s]))]
                    a, b = sides[0], sides[-1]
                    p = _parts(c, shape)
                    hit = verify(int(t[s]), (x[a], c[a], p[a]), (x[b], c[b], p[b]), len(sides) == 1, least, shape.parts)
                    u, v = np.nonzero(hit)
                    if not len(u):
                        continue
                    label = local_components(len(at), a[u], b[v])
                    got = np.bincount(a[u], weight[at][b[v]], len(at))
                    if len(sides) == 2:
                        got += np.bincount(b[v], weight[at][a[u]], len(at))
                    on = np.flatnonzero(got)
                    rows.append((node[at][on], node[at][label[on]], got[on].astype(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["node", "root", "links"])

    return dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j").select("t", "k", "i", "j", "block", "node", "weight", "vec", "codes").mapInArrow(each, "node long, root long, links long")


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """A row (vec_id, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))  # minus zero is zero
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole.alias("vec"))
    fit = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(fit, F.col("vec"))).withColumn("h1", F.when(fit, F.xxhash64("vec"))).withColumn("h2", F.when(fit, F.xxhash64(F.lit(1), "vec")))
    ids = written(rows.select("vec_id", "h1", "h2"), "vector-ids")
    nodes = rows.filter("vec IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.any_value("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    sample: dict[int, list] = {}
    for r in nodes.orderBy("h1", "h2").limit(SAMPLE).select("vec").toArrow()["vec"]:
        sample.setdefault(len(r), []).append(r.values.to_numpy())
    shape = Shape.of(nodes.count())
    turns = {d: learn(np.stack(x), shape.rotations) if len(x) >= d else _unlearned(d, shape.rotations) for d, x in sample.items()}

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec = [v.values.to_numpy() for v in batch.column("vec")]
        out = np.zeros((len(vec), shape.rotations), np.uint64)
        size = np.array([len(v) for v in vec])
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            out[at] = codes(np.stack([vec[i] for i in at]), turns.get(int(d)) or _unlearned(int(d), shape.rotations))
        flat = pa.array(out.view(np.int64).ravel())
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, shape.rotations, dtype=np.int32), flat)], names=["node", "codes"])

    coded = written(map_arrow(nodes.select("node", "vec"), code, "node long, codes array<long>"), "codes")
    entries = [
        F.struct(F.lit(r * shape.parts + p).alias("t"), F.shiftrightunsigned(F.get("codes", F.lit(r)), shape.width * p).bitwiseAND(F.lit((1 << shape.width) - 1)).alias("k"), F.get("codes", F.lit(r)).alias("code"))
        for r in range(shape.rotations) for p in range(shape.parts)
    ]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, k, b, node, own in whole_groups(batches, 3):
            at = np.flatnonzero(near_members(group_numbers([t, k, b]), own.view(np.uint64)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (t, k, node)], names=["t", "k", "node"])

    buckets = in_blocks(coded.select("node", F.explode(F.array(*entries)).alias("e")).select("e.t", "e.k", "node", "e.code"), ["t", "k"], "node", CODE_BLOCK)
    buckets = buckets.select("t", "k", "b", "node", "code").repartition("t", "k", "b").sortWithinPartitions("t", "k", "b")
    members = written(buckets.mapInArrow(near, "t int, k long, node long").distinct(), "members")
    blocks = members.groupBy("t", "k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (
        members.join(blocks, ["t", "k"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("*", other)
        .select("t", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
        .join(nodes.select("node", "weight", "vec"), "node").join(coded, "node")
    )
    linked = written(links(dealt, least, shape), "vector-links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = nodes.select("node", "h1", "h2", "low", "weight").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    told = classed.join(lows, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = ids.join(told, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
