"""Packing by column generation for the cutting-stock problem.

Each document, its token ids and an end id, is cut into full sequences and one remainder. Remainders are counted by length
class (UNIT tokens wide). A linear program over patterns (which classes share a sequence) covers the histogram with the
fewest sequences: its patterns are generated as needed by a knapsack dynamic program priced with (steadied) dual values,
until the bound shows that no more than GAP is to be gained. Copies of patterns are rounded down, and the n-th document of a
class, by rank, goes where the n-th place for that class is.

Remainders without a place (rounding, and patterns with much room left) are laid end to end and cut at every full
sequence; what is left in the end is cut into powers of two, which need no padding.

Only the histogram (a row for each class) and the patterns, a few for each class at most, come to the driver. Ranks and running sums are made
within hash buckets of rows and set off by sums over buckets, so a class that holds a third of all rows is no single task.
Null texts are empty (one token, the end id). Repeated rows are packed as often as they occur; an empty table gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import byte_chars, doc_columns, map_arrow, tokenizer_path, written
from mapweave.llm.token_counts import PRE_TOKENS

#: Tokens to a length class; largest share by which the patterns may miss the bound; room above which a pattern isn't used; weight of the duals in prices.
UNIT, GAP, ROOM, STEADY = 8, 0.001, 1 / 64, 0.1
#: Rows to a bucket, and rows up to which documents to be cut are looked up by broadcast.
BUCKET, BROADCAST = 100_000, 50_000


@cache
def fast_encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: ids are in merge order, so they are its ranks. Tests hold it against the library."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))  # the vocabulary only: a whole tokenizer would stay in every worker
    code = {c: b for b, c in enumerate(byte_chars())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str, end: int) -> np.ndarray:
    ids = fast_encoder(path).encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    return np.append(ids, np.uint32(end)).astype("<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def price(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within room (unbounded knapsack by dynamic programming); sizes ascending."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    usable = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if usable[c]:
            reach = best[c - sizes[: usable[c]]] + values[: usable[c]]
            k = int(reach.argmax())
            if reach[k] > best[c] + 1e-12:
                best[c], taken[c] = reach[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(best[room]), counts


def cutting_stock(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> how many) and copies of each, rounded down, that use no more than the histogram has."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[s] for s in sizes], float)
    fits = room // sizes
    columns, cost = np.diag(fits.astype(float)), np.ones(len(sizes))  # of the basis: pattern j is column j
    inverse, x = np.diag(1.0 / fits), need / fits
    dual, bound = inverse.sum(axis=0), 0.0
    for _ in range(30 * len(sizes)):
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # more of a class than there is costs nothing: its places stay empty
            new, c = np.zeros(len(sizes)), 0.0
            new[worst] = -1
        else:
            c = 1.0
            for share in (STEADY, 0.6, 1.0):
                # duals leap about; sizes over room are near the best ones, so prices lean to them as long as they find a better pattern
                priced = share * dual + (1 - share) * sizes / room
                value, new = price(sizes, np.maximum(priced, 0), room)
                bound = max(bound, float(np.maximum(priced, 0) @ need) / max(value, 1))
                if float(dual @ new) > 1 + 1e-9:
                    break
            else:
                break
            if x @ cost <= bound * (1 + GAP):
                break
        step = inverse @ new
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        gain = c - float(dual @ new)
        row = inverse[out] / step[out]
        touched = np.flatnonzero(np.abs(step) > 1e-12)
        inverse[touched] -= step[touched, None] * row[None, :]
        inverse[out] = row
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        dual = dual + gain * row
        columns[:, out], cost[out] = new, c
    left, found = need.copy(), []
    for j in np.argsort(-x, kind="stable"):
        a = columns[:, j]
        on = a > 0
        if not cost[j]:
            continue
        copies = int(min(np.floor(x[j] + 1e-6), np.floor((left[on] / a[on]).min())))
        if copies > 0 and room - float(a @ sizes) <= ROOM * room:
            left -= copies * a
            found.append(({int(s): int(k) for s, k in zip(sizes[on], a[on], strict=True)}, copies))
    return found


def cover(histogram: dict[int, int], room: int, rounds: int = 3) -> list[tuple[dict[int, int], int]]:
    """Patterns for the histogram, then for what rounding down has left of it, while that is over a hundredth."""
    left, found = dict(histogram), []
    whole = sum(s * n for s, n in left.items())
    for _ in range(rounds):
        new = cutting_stock(left, room)
        for pattern, copies in new:
            for size, k in pattern.items():
                left[size] -= k * copies
        found += new
        if not new or sum(s * n for s, n in left.items()) <= 0.01 * whole:
            break
    return found


def places(patterns: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """By class: first ranks of its runs of places, each run's first sequence, places to a sequence and first slot; and the number of sequences."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, copies in patterns:
        slot = 0
        for size, k in pattern.items():
            runs.setdefault(size, []).append((used.get(size, 0), first, k, slot))
            used[size] = used.get(size, 0) + k * copies
            slot += k
        first += copies
    return {s: (*np.array(r, np.int64).T, used[s]) for s, r in runs.items()}, first


def _tail(total: int, room: int) -> np.ndarray:
    """Ends of the sequences in the stream of what has no place: every room tokens, then powers of two."""
    ends, at = [], total - total % room
    for b in range(room.bit_length(), -1, -1):
        if (total % room) >> b & 1:
            at += 1 << b
            ends.append(at)
    return np.array(ends, np.int64)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 1, room: int = 2048) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. room: a power of two."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, sums = [], []
        for t in batch.column(1):
            ids = encode(path, t.as_py() or "", end)
            sizes.append(len(ids))
            sums.append([crc(ids[k : k + room]) for k in range(0, len(ids), room)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "doc_tokens", "sums"])

    texts = doc_columns(docs, key, text).withColumn("text_hash", F.xxhash64("text"))
    counted = map_arrow(texts, count, "doc_id long, text_hash long, doc_tokens long, sums array<long>")
    counted = written(counted.withColumn("row", F.monotonically_increasing_id()), "token-counts")
    buckets = max(1, -(-counted.count() // BUCKET))
    rest = F.col("doc_tokens") % room
    rows = (
        counted.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / room))
        .withColumn("rest", rest).withColumn("class", F.ceil(rest / UNIT).cast("int"))
    )

    sums = written(rows.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "class-sums")
    histogram = {r["class"]: r["n"] for r in sums.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    n_full = sums.agg(F.sum("full")).first()[0] or 0
    table, n_packed = places(cover({c: n for c, n in histogram.items() if c}, room // UNIT))

    before = (Window.unboundedPreceding, -1)
    of_class = sums.select("bucket", "class", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("class_before"))
    by_bucket = sums.groupBy("bucket").agg(F.sum("full").alias("full"))
    of_bucket = by_bucket.select("bucket", F.coalesce(F.sum("full").over(Window.orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("full_before"))
    ranked = (
        rows.withColumn("first_full", F.coalesce(F.sum("full").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(*before)), F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "class").orderBy("row")) - 1)
        .join(of_class, ["bucket", "class"]).join(of_bucket, "bucket")
        .select("doc_id", "text_hash", "doc_tokens", "sums", "row", "bucket", "full", "rest", "class", (F.col("first_full") + F.col("full_before")).alias("first_full"), (F.col("rank") + F.col("class_before")).alias("rank"))
    )

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
        seq, slot = np.full(len(cls), -1, np.int64), np.zeros(len(cls), np.int64)
        for c in np.unique(cls):
            if c in table:
                starts, first, each, slots, used = table[c]
                at = np.flatnonzero((cls == c) & (rank < used))
                run = np.searchsorted(starts, rank[at], side="right") - 1
                past = rank[at] - starts[run]
                seq[at] = first[run] + past // each[run]
                slot[at] = slots[run] + past % each[run]
        return batch.append_column("seq", pa.array(seq)).append_column("slot", pa.array(slot))

    ordered = ["doc_id", "text_hash", "doc_tokens", "sums", "row", "bucket", "full", "rest", "class", "first_full", "rank"]
    kinds = dict(ranked.dtypes)
    assigned = written(map_arrow(ranked, assign, ", ".join(f"`{c}` {kinds[c]}" for c in ordered) + ", seq long, slot long"), "places")

    full = (
        assigned.filter("full > 0").select("doc_id", "doc_tokens", "first_full", "full", F.posexplode(F.slice("sums", 1, F.col("full").cast("int"))).alias("i", "crc"))
        .select("doc_id", (F.col("i") * F.lit(room).cast("long")).alias("start"), F.lit(room).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    last = F.element_at("sums", -1)
    in_order = Window.partitionBy("seq").orderBy("slot").rowsBetween(*before)
    placed = assigned.filter("rest > 0 AND seq >= 0").select(
        "doc_id", (F.col("full") * room).alias("start"), F.col("rest").alias("length"), last.alias("ids_crc32"), "doc_tokens",
        (F.col("seq") + n_full).alias("sequence_id"), F.coalesce(F.sum("rest").over(in_order), F.lit(0)).alias("offset"),
    )
    stream = _stream(assigned.filter("rest > 0 AND seq < 0"), texts, path, end, room, n_full + n_packed)
    return full.unionByName(placed).unionByName(stream)


def _stream(loose: DataFrame, texts: DataFrame, path: str, end: int, room: int, first: int) -> DataFrame:
    """Pieces of the remainders that have no place: laid end to end and cut."""
    before = (Window.unboundedPreceding, -1)
    by_bucket = loose.groupBy("bucket").agg(F.sum("rest").alias("n"))
    total = by_bucket.agg(F.sum("n")).first()[0] or 0
    ends = _tail(total, room)
    whole = total // room
    laid = (
        loose.withColumn("at", F.coalesce(F.sum("rest").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(*before)), F.lit(0)))
        .join(by_bucket.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("base")), "bucket")
        .select("doc_id", "text_hash", "doc_tokens", F.element_at("sums", -1).alias("crc"), (F.col("full") * room).alias("start"), "rest", (F.col("at") + F.col("base")).alias("at"))
    )

    def cuts(at: int, size: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a remainder that lies at `at`."""
        out, here = [], at
        while here < at + size:
            k = here // room
            if k < whole:
                to, seq, begin = (k + 1) * room, k, k * room
            else:
                j = int(np.searchsorted(ends, here, side="right"))
                to, seq, begin = int(ends[j]), whole + j, whole * room if j == 0 else int(ends[j - 1])
            to = min(to, at + size)
            out.append((here - at, to - here, first + seq, here - begin))
            here = to
        return out

    def whole_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, tokens, sum_, start, rest, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crc", "start", "rest", "at")), strict=True):
            got = cuts(at, rest)
            if len(got) == 1:
                rows.append((doc, start, rest, sum_, tokens, got[0][2], got[0][3]))
        return _record(rows)

    def cut_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, tokens, start, rest, at, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "rest", "at", "text")), strict=True):
            ids = encode(path, text or "", end)[start:]
            rows += [(doc, start + s, n, crc(ids[s : s + n]), tokens, seq, off) for s, n, seq, off in cuts(at, rest)]
        return _record(rows)

    here, after = F.col("at"), F.col("at") + F.col("rest")
    inner = F.exists(F.array(*[F.lit(int(e)) for e in ends]).cast("array<long>"), lambda e: (here < e) & (e < after))
    laid = written(laid.withColumn("cut", inner | (F.floor(here / room) != F.floor((after - 1) / room))), "stream")
    same = (F.col("t.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("t.text_hash").eqNullSafe(F.col("c.text_hash")))
    cut = laid.filter("cut")
    keys = cut.select("doc_id", "text_hash").distinct()
    n_cut = whole + len(ends)  # no more can be cut than there are ends
    once = texts.alias("t").join((F.broadcast(keys) if n_cut <= BROADCAST else keys).alias("c"), same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    looked_up = once.alias("t").join(cut.alias("c"), same).select("c.doc_id", "c.doc_tokens", "c.start", "c.rest", "c.at", "t.text")
    return map_arrow(laid.filter("NOT cut"), whole_pieces, PIECE).unionByName(map_arrow(looked_up, cut_pieces, PIECE))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
