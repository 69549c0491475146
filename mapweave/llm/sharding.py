"""Sharding by histogram sort: near-equal bytes in every shard, one exchange.

Rows are ordered by (hash of the text, hash of the key, row number), so equal texts are neighbours. To cut that order into
pieces of equal bytes, candidate boundaries are probed: exact bytes and rows below each probe are counted over all
partitions (a small aggregation), the probes move in between the two that enclose a target, and so on until the bytes
between them are within tolerance. Then every row knows its piece, and its rank there after one exchange by piece; the
counts below the boundaries give the slots without another one.

Copies of one text stay together, in one shard, unless they weigh over a hundredth of a shard (`together`): then their group
is cut by key, as any other range. Null texts have size 8 and CRC 0 and stand with empty ones; null keys and repeated rows are ordered by row number;
an empty table gives no rows. Shards with no rows are possible if there are fewer rows than shards.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import text_or_empty, written

#: The first round counts this many equal cells of the hash range (as bits); later rounds so many probes between two others.
CELL_BITS, PROBES = 12, 256
KEYS = ("k0", "k1", "k2")


@dataclass
class _Search:
    """The range (lo to hi of one key column, the columns before it fixed) that holds a target, and what lies below it."""

    target: int
    level: int = 0
    fixed: tuple[int, ...] = ()
    lo: int = 0
    hi: int = (1 << 63) - 1
    below: int = 0
    rows_below: int = 0
    size: int = 0
    rows: int = 0
    found: tuple[int, ...] | None = None
    place: tuple = field(default=())

    @property
    def range(self) -> tuple:
        return (self.level, self.fixed, self.lo, self.hi)


def _settle(s: _Search, at_end: bool) -> None:
    """Puts the boundary at the start or just behind the end of the range."""
    key = [*s.fixed, s.hi + 1 if at_end else s.lo]
    s.found = (*key, *[0] * (3 - len(key)))
    s.below += s.size * at_end
    s.rows_below += s.rows * at_end


def splitters(keyed: DataFrame, pieces: int, tolerance: float, whole: float = 0.0) -> tuple[list[_Search], int]:
    """A settled search for each of the pieces - 1 targets, in order, and the number of all rows.

    Rows of one first key are cut only if they weigh more than the share `whole` of all bytes.
    """
    shift = 63 - CELL_BITS
    first = keyed.groupBy(F.shiftright("k0", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("k0").alias("lo"), F.max("k0").alias("hi")).orderBy("cell").collect()
    total, rows = sum(r["size"] for r in first), sum(r["rows"] for r in first)
    close = max(1.0, tolerance * total / max(pieces, 1))

    def enter(s: _Search, parts: list) -> None:
        """Moves into the part that holds the target. parts: (lo, hi, size, rows) in order."""
        below, rows_below = s.below, s.rows_below
        for lo, hi, size, n in parts:
            if below + size >= s.target or (lo, hi) == parts[-1][:2]:
                s.lo, s.hi, s.below, s.rows_below, s.size, s.rows = lo, hi, below, rows_below, size, n
                break
            below, rows_below = below + size, rows_below + n
        group = s.lo == s.hi and s.level == 0 and s.size <= whole * total
        if s.size <= close or group or s.rows == 1 or (s.lo == s.hi and s.level == 2):
            _settle(s, at_end=2 * (s.target - s.below) > s.size)
        elif s.lo == s.hi:  # one value: go on with the next column
            s.fixed, s.level, s.lo, s.hi = (*s.fixed, s.lo), s.level + 1, 0, (1 << 63) - 1

    searches = [_Search(target=total * j // pieces) for j in range(1, pieces)]
    for s in searches:
        if first:
            enter(s, [(r["lo"], r["hi"], r["size"], r["rows"]) for r in first])
        else:
            _settle(s, at_end=False)
    while open_ := [s for s in searches if s.found is None]:
        ranges = {s.range: None for s in open_}
        spec = []
        for i, (level, fixed, lo, hi) in enumerate(ranges):
            k0 = fixed[0] if fixed else lo
            spec.append((i, k0 >> shift, level, *(list(fixed) + [0, 0])[:2], lo, hi, (hi - lo) // PROBES + 1))
        probe = keyed.sparkSession.createDataFrame(spec, "i int, cell long, level int, f0 long, f1 long, lo long, hi long, width long")
        now = F.when(F.col("level") == 0, F.col("k0")).when(F.col("level") == 1, F.col("k1")).otherwise(F.col("k2"))
        inside = now.between(F.col("lo"), F.col("hi")) & ((F.col("level") < 1) | (F.col("k0") == F.col("f0"))) & ((F.col("level") < 2) | (F.col("k1") == F.col("f1")))
        counted = (
            keyed.withColumn("cell", F.shiftright("k0", shift)).join(F.broadcast(probe), "cell").filter(inside)
            .groupBy("i", F.floor((now - F.col("lo")) / F.col("width")).alias("part"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(now).alias("lo"), F.max(now).alias("hi")).collect()
        )
        parts: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["i"], r["lo"])):
            parts.setdefault(r["i"], []).append((r["lo"], r["hi"], r["size"], r["rows"]))
        number = {x: i for i, x in enumerate(ranges)}
        for s in open_:
            enter(s, parts[number[s.range]])
    return searches, rows


def _piece(bounds: list[tuple[int, ...]], spark) -> tuple[DataFrame, Column]:
    """A table by cell (4096 rows at most) and the expression that gives a row's piece from it."""
    shift = 63 - CELL_BITS
    cells = range(1 << CELL_BITS)
    held: dict[int, list] = {}
    for b in bounds:
        held.setdefault(b[0] >> shift, []).append(b)
    rows = [(c, bisect_left(bounds, (c << shift, 0, 0)), [tuple(b) for b in held.get(c, [])]) for c in cells]
    table_ = spark.createDataFrame(rows, "cell long, before int, bounds array<struct<k0: long, k1: long, k2: long>>")
    return table_, F.col("before") + F.size(F.filter("bounds", lambda b: b <= F.struct(*KEYS)))


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", tolerance: float = 0.001, together: float = 0.01, piece_rows: int = 50_000, most_pieces: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not the law).

    tolerance: bytes by which a boundary may miss, of a piece. together: of a shard, up to which equal texts aren't cut. piece_rows, most_pieces: a shard is put in order in so many
    pieces that each has about piece_rows rows, and most_pieces at most.
    """
    spark, body = docs.sparkSession, text_or_empty(text)
    keyed = written(
        docs.select(
            F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 1).alias("k0"), F.shiftrightunsigned(F.xxhash64(F.col(key).cast("long")), 1).alias("k1"), F.monotonically_increasing_id().alias("k2"),
        ), "sizes",
    )
    per_shard = max(1, min(most_pieces, -(-keyed.count() // (shards * piece_rows))))
    found, rows = splitters(keyed, shards * per_shard, tolerance, together / shards)
    starts = [0, *(s.rows_below for s in found), rows]
    cells, piece = _piece([s.found for s in found], spark)
    first_slot = spark.createDataFrame([(p, starts[p] - starts[p - p % per_shard]) for p in range(shards * per_shard)], "piece int, first long")
    ranked = (
        keyed.withColumn("cell", F.shiftright("k0", 63 - CELL_BITS)).join(F.broadcast(cells), "cell").withColumn("piece", piece)
        .withColumn("at", F.row_number().over(Window.partitionBy("piece").orderBy(*KEYS)))
    )
    return ranked.join(F.broadcast(first_slot), "piece").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("piece") / per_shard).cast("int").alias("shard"),
        (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
