"""Near-duplicate detection by SimHash with pivot distance tables.

A fingerprint takes, for each of 64 bits, the majority over the XXH64 hashes of all shingles of words. Two fingerprints are
linked if at most `bits` bits differ.

Distances to eight fixed reference fingerprints (pivots) are computed once for each fingerprint and travel with it, a byte each. By the
triangle inequality no coordinate of two linked fingerprints differs by more than `bits`. Within a bucket, members are sorted by
the first coordinate, so that only a window is looked at; pairs with a larger difference in another coordinate are discarded,
and only the rest is verified on all 64 bits. Since the coordinates of unrelated fingerprints lie close together, pivots alone
would leave most pairs to look at; so the fingerprints are first dealt out by parts: of bits + 3 parts of the bits at least three
agree in any linked pair, which therefore meets in one of the tables by three parts. No link is lost.

Equal fingerprints are one node, so groups of copies cost one row. Within a bucket only its components are passed on, one
row for each member, never the pairs. Large buckets are dealt out in blocks, a task for each pair of blocks.

Null and empty texts have fingerprint zero and are linked like any other; repeated rows and ties are equal fingerprints;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.blocks import in_blocks
from mapweave.llm.common import doc_columns, group_numbers, map_arrow, shingles, whole_groups, written
from mapweave.llm.components import connected_components, local_components
from mapweave.llm.pivots import coordinates, linked, majority, packed, references, unpacked
from mapweave.llm.set_join import links_of_sets, node_rows

#: Parts of the bits that agree under each table; differing bits that may be asked for.
AGREEING, MOST_BITS = 3, 12
PIVOTS = references(1)
#: Members of a bucket up to which all its pairs are put through the tables at once; members to a block of a larger bucket.
AT_ONCE, BLOCK = 64, 4096


def fingerprint(text: str | bytes | None, words: int = 4) -> int:
    import xxhash

    pieces = shingles(text, words)
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(p, 42) for p in pieces]), np.uint8).reshape(-1, 8)
    return int.from_bytes(majority(digests).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """A row (doc_id, text_hash, fp: the fingerprint's bits as a long, pivots: its distances) for each row of docs."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(b if (b := v.as_buffer()) is None else b.to_pybytes(), words) for v in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got.view(np.int64)), pa.array(packed(coordinates(got[:, None], PIVOTS)))], names=["doc_id", "text_hash", "fp", "pivots"])

    return map_arrow(doc_columns(docs, key, text).withColumn("text_hash", F.xxhash64("text")), each, "doc_id long, text_hash long, fp long, pivots long")


def masks(bits: int) -> list[int]:
    """For 64-bit numbers that differ in `bits` bits at most: masks of which one at least shows them equal."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"fingerprints are linked at 0 to {MOST_BITS} differing bits")
    parts = bits + AGREEING
    cuts = [round(i * 64 / parts) for i in range(parts + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(part, AGREEING)]


def _walk(fp: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Components of one large bucket, sorted by the first coordinate: from each node to what it is linked to among those not met yet."""
    label, rest = np.arange(len(fp)), np.arange(len(fp))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            x = front.pop()
            lo, hi = np.searchsorted(table[rest, 0], [table[x, 0] - bits, table[x, 0] + bits + 1])
            near = lo + linked(fp, table, np.full(hi - lo, x), rest[lo:hi], bits)
            if len(near):
                label[rest[near]] = seed
                front += rest[near].tolist()
                rest = np.delete(rest, near)
    return label


def bucket_links(group: np.ndarray, node: np.ndarray, fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """group: bucket numbers; fp: (rows, words); table: coordinates. Sorted by group, then by the first coordinate.

    Gives each member's node and that of a member of its component in the bucket, where they differ.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    label = np.arange(len(fp))
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= AT_ONCE), sizes))
    if len(at):
        sub, own, rows, a, b = fp[at], group[at], table[at], [], []
        i = np.arange(len(at))
        for step in range(1, AT_ONCE):
            i = i[i + step < len(at)]
            i = i[(own[i + step] == own[i]) & (rows[i + step, 0] - rows[i, 0] <= bits)]  # once the next is too far, all further ones are
            if not len(i):
                break
            met = i[linked(sub, rows, i, i + step, bits)]
            a.append(met)
            b.append(met + step)
        if a:
            label[at] = at[local_components(len(at), np.concatenate(a), np.concatenate(b))]
    for s, n in zip(starts[sizes > AT_ONCE], sizes[sizes > AT_ONCE], strict=True):
        label[s : s + n] = s + _walk(fp[s : s + n], table[s : s + n], bits)
    apart = np.flatnonzero(label != np.arange(len(fp)))
    return node[apart], node[label[apart]]


def links_of(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes: distinct fingerprints (fp, pivots). Links (a, b) that have the components of all pairs within `bits` bits."""
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(bits))])
    dealt = in_blocks(nodes.select("fp", "pivots", F.explode(entries).alias("e")).select("e.t", "e.k", "fp", "pivots"), ["t", "k"], "fp", BLOCK)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, k, b, pivots, fp in whole_groups(batches, 3):
            a, b = bucket_links(group_numbers([t, k, b]), fp, fp[:, None].view(np.uint64), unpacked(pivots), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["t", "k", "b"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "pivots").select(*order, "pivots", "fp").mapInArrow(each, "a long, b long")


def _classed(prints: DataFrame, nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """prints with component_id (the smallest doc_id reachable over links) and root, which names the component. nodes: node, low and the column `by` of prints."""
    classed = nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(classed.select(by, "root").join(lows, "root"), by)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """A row (doc_id, text_hash, fp, component_id, root) for each row of docs."""
    prints = written(fingerprints(docs, key, text, words), "fingerprints")
    nodes = written(prints.groupBy("fp", "pivots").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp")), "nodes")
    return _classed(prints.drop("pivots"), nodes, links_of(nodes.select("fp", "pivots"), bits), "fp")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row (doc_id, text_hash, node, component_id, root) for each row of docs; links are all pairs whose sets of shingles have that Jaccard similarity."""
    made, hot = node_rows(docs, key, text, words, similarity)
    rows = written(made, "set-prints")
    prints = rows.select("doc_id", "text_hash", "node")
    return _classed(prints, prints.groupBy("node").agg(F.min("doc_id").alias("low")), links_of_sets(rows, docs, key, text, words, similarity, hot), "node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """A row (doc_id, fingerprint, component_id) for each row of docs."""
    return classes(docs, key, text, words, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest key (then the least hash of the text); null keys come last.

    Rows are known by key and hash of the text. Those to go are taken out by a broadcast while they are broadcast_rows at
    most, else by a shuffled join. Only rows that repeat in key and text are shuffled to keep one of them.
    """
    known = written(similar_classes(docs, key, text, words, similarity).groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("n")), "known-rows")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = known.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), rank).alias("first")).select("first.*")
    first = written(first, "first-rows")

    def matching(how: str, listed: DataFrame) -> DataFrame:
        mine = docs.alias("mine")
        side = F.broadcast(listed) if listed.count() <= broadcast_rows else listed
        same = F.col(f"mine.`{key}`").cast("long").eqNullSafe(F.col("listed.doc_id")) & F.xxhash64(F.col(f"mine.`{text}`").cast("string")).eqNullSafe(F.col("listed.text_hash"))
        return mine.join(side.alias("listed"), same, how)

    same = (F.col("k.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("k.text_hash") == F.col("f.text_hash"))
    gone = written(known.alias("k").join(first.alias("f"), same, "left_anti").select("doc_id", "text_hash"), "rows-to-go")
    repeated = first.filter("n > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return matching("left_anti", gone)
    once = matching("left_semi", repeated).dropDuplicates([key, text])
    return matching("left_anti", written(gone.unionByName(repeated), "rows-apart")).unionByName(once)
