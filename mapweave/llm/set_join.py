"""Join of texts whose sets of shingles have a Jaccard similarity of at least `similarity`: prefixes, SimHash, verification.

Two such sets share one of their first n - ceil(similarity * n) + 1 shingles in any order that is the same for all sets, so sets
are dealt out by these shingles and no pair is lost. The order puts shingles that are frequent in a part of the documents last;
it decides how many sets meet, never which pairs are linked.

A pair that meets is dropped if sizes or the places of the shared shingle prove a lower similarity, or if fingerprints of 128 bits
(majority over the distinct shingles) lie further apart than sets of that similarity ever do: the limit stands six standard
deviations beyond the distance expected at the similarity (43.7 of 128 bits for 0.8), a chance of about one in a thousand millions
for a pair at the very limit, less for closer ones. Members of a bucket serve as pivots: what differs in its distance to a
pivot by more than the limit isn't compared. Every pair that is left is a link only if the whole sets, made anew from the
texts, verify it.

Since only components are wanted, every member of a bucket is first verified against one representative, then against the nearest
member of another component; then all pairs of members that still lie in different components are. Groups
of near copies thus cost a few rows for each member, not one for each pair.
Buckets of frequent shingles are dealt out in blocks.

Equal sets are one node. Texts without words are one node too; shorter texts than a shingle are their whole sequence of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.blocks import in_blocks
from mapweave.llm.common import doc_columns, drop_written, group_numbers, map_arrow, shingles, whole_groups, written
from mapweave.llm.components import connected_components
from mapweave.llm.pivots import linked, majority

#: One document of PART makes the order (of SAMPLE documents and fewer, all); frequent shingles that it knows.
SAMPLE, PART, FREQUENT = 20_000, 16, 300_000
#: Members of a bucket, or partners of a node, to a block.
BLOCK = 8192
#: Nodes whose texts are picked out by a broadcast; more are by a shuffled join.
BROADCAST = 500_000
#: Pairs that are put out at once.
AT_ONCE = 1 << 20
ROUNDING = 1e-9
#: Bits of a fingerprint; sets smaller than this lie further apart, since few shingles make each bit.
BITS, FEW, FEW_SHARE = 128, 32, 0.1875


def bits_of(similarity: float, share: float = 0.0) -> int:
    """Differing bits that sets of this similarity don't pass. share: of bits expected to differ, if that is more."""
    share = max(share, math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return math.ceil(BITS * share + 6 * math.sqrt(BITS * share * (1 - share)))


def digests_of(text: str | bytes | None, words: int) -> np.ndarray:
    """128-bit hashes of the distinct shingles, rows of bytes."""
    import xxhash

    return np.frombuffer(b"".join({xxhash.xxh3_128_digest(p, 42) for p in shingles(text, words)}), np.uint8).reshape(-1, 16)


def items_of(digests: np.ndarray) -> np.ndarray:
    """Half of each hash as a number, ascending."""
    return np.unique(np.ascontiguousarray(digests[:, :8]).view(np.int64).ravel())


def _raw(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    return (b if (b := v.as_buffer()) is None else b.to_pybytes() for v in batch.column(column))


def _lists(of: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in of])])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*of, np.zeros(0, np.int64)]), pa.int64())).cast(pa.list_(pa.int64()))


def frequent(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the documents drawn have, ascending, and in how many of all documents they are to be expected."""
    part = min(max(1, docs.count() // SAMPLE), PART)
    drawn = docs.select(F.col(text).cast("string").alias("t")).filter(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(part)) == 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in _raw(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(items_of(digests_of(raw, words)))], names=["s"])

    counts = drawn.mapInArrow(each, "s long").groupBy("s").count().filter("count > 2")
    got = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).orderBy("s").toArrow()
    return got["s"].to_numpy(), got["count"].to_numpy() * part


def prefix(items: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles, in order, of which a similar set shares one."""
    rank = np.zeros(len(items), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        rank = np.where(common[at] == items, counts[at], 0)
    least = int(np.ceil(similarity * len(items) - ROUNDING))
    return items[np.lexsort((items, rank))[: len(items) - least + 1]]


def node_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, list[tuple[int, int]]]:
    """A row (doc_id, text_hash, node: names the set, n: its size, f0 and f1: its fingerprint, head: its prefix) for each row of docs; and frequent shingles with the parts of their buckets."""
    import xxhash

    common, counts = frequent(docs, text, words)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, n, prints, heads = [], [], [], []
        for raw in _raw(batch, 1):
            digests = digests_of(raw, words)
            items = items_of(digests)
            node.append(xxhash.xxh3_64_intdigest(items.tobytes(), 42))
            n.append(len(items))
            prints.append(majority(digests))
            heads.append(prefix(items, common, counts, similarity) if len(items) else items)
        f = np.stack(prints).view(np.int64)
        columns = [batch.column(0), batch.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(f[:, 0])), pa.array(np.ascontiguousarray(f[:, 1])), _lists(heads)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "n", "f0", "f1", "head"])

    rows = map_arrow(doc_columns(docs, key, text).withColumn("text_hash", F.xxhash64("text")), each, "doc_id long, text_hash long, node long, n long, f0 long, f1 long, head array<long>")
    return rows, [(int(s), -(-int(c) // BLOCK)) for s, c in zip(common, counts, strict=True) if c > BLOCK]


def _possible(n: np.ndarray, at: np.ndarray, other_n: np.ndarray, other_at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, whose first shared shingle stands at these positions, may be similar enough."""
    needed = np.ceil(similarity / (1 + similarity) * (n + other_n) - ROUNDING)
    return (np.minimum(n, other_n) >= similarity * np.maximum(n, other_n) - ROUNDING) & (np.minimum(n - at, other_n - other_at) >= needed)


def middle_members(group: np.ndarray, node: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For each member of sorted groups the one whose fingerprint lies nearest to what most of them have: of near copies, their source."""
    _, group = np.unique(group, return_inverse=True)
    size, counts = np.bincount(group), np.zeros((group[-1] + 1, BITS), np.int32)
    bytes_ = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1)
    for k in range(0, len(fp), AT_ONCE // 8):
        part = group[k : k + AT_ONCE // 8]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts[part[starts]] += np.add.reduceat(np.unpackbits(bytes_[k : k + AT_ONCE // 8], axis=1), starts, dtype=np.int32)
    middle = np.packbits(2 * counts > size[:, None], axis=1)
    far = np.bitwise_count(bytes_ ^ middle[group]).sum(axis=1, dtype=np.int64)
    order = np.lexsort((node, far, group))
    return order[np.concatenate([[True], group[order][1:] != group[order][:-1]])][group]


def _limits(n: np.ndarray, other_n: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(np.minimum(n, other_n) < FEW, bits_of(similarity, FEW_SHARE), bits_of(similarity))


def shared_shingles(rows: DataFrame, hot: list[tuple[int, int]], similarity: float) -> DataFrame:
    """Rows (shingle, node, na: size and place, f0, f1, first, far) of shingles in prefixes of several nodes.

    first: the representative of the member's part of the bucket, at a distance of `far` bits; null where it can't be similar or is the member itself.
    hot: frequent shingles, and the parts of their buckets.
    """
    heads = rows.select("node", "n", "f0", "f1", "head").dropDuplicates(["node"])
    dealt = heads.select("node", "n", "f0", "f1", F.posexplode("head").alias("at", "shingle")).withColumn("na", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")))
    salt = F.lit(-1).cast("long")
    if hot:
        dealt = dealt.join(F.broadcast(rows.sparkSession.createDataFrame(hot, "shingle long, parts long")), "shingle", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(-1).cast("long"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, salt, node, na, f0, f1 in whole_groups(batches, 2):
            group = group_numbers([shingle, salt])
            keep = (np.bincount(group)[group] > 1) | (salt >= 0)
            if not keep.any():
                continue
            group, shingle, node, na, f0, f1 = (c[keep] for c in (group, shingle, node, na, f0, f1))
            n, at, fp = na >> 32, na & 0xFFFFFFFF, np.stack([f0, f1], axis=1).view(np.uint64)
            first = middle_members(group, node, fp)
            far = np.bitwise_count(fp ^ fp[first]).sum(axis=1, dtype=np.int64)
            fits = _possible(n, at, n[first], at[first], similarity) & (first != np.arange(len(node))) & (far <= _limits(n, n[first], similarity))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shingle, node, na, f0, f1)] + [pa.array(node[first], mask=~fits), pa.array(far.astype(np.int32))], names=["shingle", "node", "na", "f0", "f1", "first", "far"])

    columns = dealt.select("shingle", salt.alias("salt"), "node", "na", "f0", "f1")
    return columns.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt").mapInArrow(each, "shingle long, node long, na long, f0 long, f1 long, first long, far int")


def _met(group: np.ndarray, n: np.ndarray, at: np.ndarray, fp: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i, j of members of a bucket (sorted by bucket, then by size) of different components that nothing rules out, and their bits."""
    wide, narrow = bits_of(similarity, FEW_SHARE), bits_of(similarity)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    run = np.repeat(starts, np.diff([*starts, len(group)]))
    pivots = np.stack([run, np.minimum(run + 1, len(group) - 1)], axis=1)  # two members of each bucket
    table = np.bitwise_count(fp[:, None, :] ^ fp[pivots]).sum(axis=2, dtype=np.int16)
    i, step = np.arange(len(n)), 0
    while len(i):  # sizes ascend: once the next one is too large for a node, all further ones are
        step += 1
        i = i[i + step < len(n)]
        i = i[(group[i] == group[i + step]) & (n[i] >= similarity * n[i + step] - ROUNDING)]
        met = i[(root[i] != root[i + step]) & _possible(n[i], at[i], n[i + step], at[i + step], similarity)]
        met = met[linked(fp, table, met, met + step, wide)]
        far = np.bitwise_count(fp[met] ^ fp[met + step]).sum(axis=1, dtype=np.int64)
        near = (far <= narrow) | (n[met] < FEW)
        if near.any():
            yield met[near], met[near] + step, far[near]


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)], names=["a", "b"])


def pairs_apart(shared: DataFrame, roots: DataFrame, hot: list[tuple[int, int]], similarity: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different components which neither a shared shingle nor the fingerprints rule out.

    With `nearest` only one for each node: the member of another component with the nearest fingerprint. These are links as a rule,
    so most components grow together before all the other pairs are asked for.
    """
    spark = shared.sparkSession
    known = F.broadcast(roots) if roots.count() <= BROADCAST else roots

    def rooted(of: DataFrame) -> DataFrame:
        return of.join(known, "node", "left").select("shingle", "na", "f0", "f1", "node", F.coalesce("root", "node").alias("root"))

    if hot:  # most of these buckets are one component by now
        listed = F.broadcast(spark.createDataFrame(hot, "shingle long, parts long").select("shingle"))
        one = rooted(shared.join(listed, "shingle")).groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("shingle")
        shared = shared.join(F.broadcast(written(one, "whole-buckets")), "shingle", "left_anti")
    rows = rooted(shared)
    dealt = in_blocks(rows, ["shingle"], "node", BLOCK)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, b, na, f0, f1, node, root in whole_groups(batches, 2):
            group = group_numbers([shingle, b])
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, group, root)
            np.maximum.at(high, group, root)
            keep = (low != high)[group]
            if not keep.any():
                continue
            group, na, f0, f1, node, root = (c[keep] for c in (group, na, f0, f1, node, root))
            order = np.lexsort((na, group))
            group, na, f0, f1, node, root = (c[order] for c in (group, na, f0, f1, node, root))
            best, other = np.full(len(node), 2 * BITS), node.copy()
            x, y, held = [], [], 0
            for i, j, far in _met(group, na >> 32, na & 0xFFFFFFFF, np.stack([f0, f1], axis=1).view(np.uint64), root, similarity):
                if nearest:
                    for p, q in ((i, j), (j, i)):
                        nearer = far < best[p]
                        best[p[nearer]], other[p[nearer]] = far[nearer], node[q[nearer]]
                    continue
                x.append(np.maximum(node[i], node[j]))
                y.append(np.minimum(node[i], node[j]))
                held += len(i)
                if held > AT_ONCE:
                    yield _distinct(x, y)
                    x, y, held = [], [], 0
            if nearest:
                order = np.lexsort((other, best, node))
                first = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
                first = first[best[first] < 2 * BITS]
                yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(other[first]), pa.array(best[first])], names=["a", "b", "far"])
            elif held:
                yield _distinct(x, y)

    columns = dealt.select("shingle", "b", "na", "f0", "f1", "node", "root").repartition("shingle", "b").sortWithinPartitions("shingle", "b")
    if not nearest:
        return written(columns.mapInArrow(each, "a long, b long").distinct(), "pairs-apart")
    chosen = columns.mapInArrow(each, "a long, b long, far long").groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    return written(chosen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs-near")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """Those of the written pairs (a, b) whose sets have the similarity.

    The set of b is read once, then those of all its a stream past; a b with very many is dealt out.
    """
    n_pairs = pairs.count()
    few = 2 * n_pairs <= BROADCAST
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = rows.select("node", "doc_id", "text_hash").join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("node", "row.*")
    texts = doc_columns(docs, key, text).withColumn("text_hash", F.xxhash64("text")).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_hash") == F.col("c.text_hash"))
    needed = texts.join((F.broadcast(chosen) if few else chosen).alias("c"), same).select("c.node", "t.text")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows give one set a task
        for batch in batches:
            got = [(k, items_of(digests_of(raw, words))) for k, raw in zip(batch.column(0).to_pylist(), _raw(batch, 1), strict=True) if not (k in seen or seen.add(k))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), _lists([x for _, x in got])], names=["node", "items"])

    sets = written(needed.mapInArrow(items, "node long, items array<long>"), "sets")
    dealt = pairs.withColumn("salt", F.lit(0).cast("long"))
    if n_pairs > BLOCK:  # a node in n_pairs / BLOCK may have more partners than a block
        large = pairs.groupBy("b").count().filter(F.col("count") > BLOCK).select("b", F.ceil(F.col("count") / BLOCK).alias("parts"))
        large = F.broadcast(large) if n_pairs // BLOCK <= BROADCAST else large
        dealt = pairs.join(large, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0).cast("long")).alias("salt"))
    own = dealt.select("b", "salt").distinct().join(sets.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "items")
    both = own.unionByName(dealt.join(sets.withColumnRenamed("node", "a"), "a").select("b", "salt", "a", "items"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = x = None
        for batch in batches:
            values, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            found = []
            for k, (b, salt, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                y = values[ends[k] : ends[k + 1]]
                if a is None:
                    name, x = (b, salt), y
                    continue
                if name != (b, salt):
                    raise ValueError("the set of a pair's node is missing")
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if common >= similarity * (len(x) + len(y) - common) - ROUNDING:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    ordered = both.repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    out = written(ordered.select("b", "salt", "a", "items").mapInArrow(each, "a long, b long").distinct(), "verified-links")
    for t in (pairs, sets):
        drop_written(t)
    return out


def links_of_sets(rows: DataFrame, docs: DataFrame, key: str, text: str, words: int, similarity: float, hot: list[tuple[int, int]]) -> DataFrame:
    """rows: written rows of node_rows. Links (a, b) that have the components of all pairs of that similarity, each verified."""
    shared = written(shared_shingles(rows, hot, similarity), "shared-shingles")
    stars = shared.filter("first IS NOT NULL").groupBy(F.col("node").alias("a")).agg(F.min_by("first", F.struct("far", "first")).alias("b"))
    check = lambda pairs: verified(pairs, rows, docs, key, text, words, similarity)
    stars = check(written(stars, "stars"))
    # a node's representative stands for its component here: that may ask for a few pairs too many, never for too few
    near = check(pairs_apart(shared, stars.toDF("node", "root"), hot, similarity, nearest=True))
    roots = connected_components(stars.union(near))
    rest = check(pairs_apart(shared, roots, hot, similarity, nearest=False))
    drop_written(shared)
    return roots.toDF("a", "b").union(rest)
