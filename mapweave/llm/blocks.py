"""Large buckets dealt out in blocks, a task for each pair of blocks, so that no bucket is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import written

#: One entry of so many is counted to find large buckets; buckets that are broadcast at most.
PART, BROADCAST = 16, 100_000


def in_blocks(entries: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """entries with a column b: the pair of blocks. All pairs of members of a bucket meet under at least one value of b.

    Large buckets are found from a part of the members, drawn by hash. That decides only how a bucket is dealt out, so a bucket
    a little over a block may stay whole; buckets of two blocks and more don't. A small bucket has b = 0.
    """
    drawn = entries.filter(F.pmod(F.xxhash64(member, F.lit(5)), F.lit(PART)) == 0)
    large = written(drawn.groupBy(*keys).count().filter(F.col("count") * PART > block).select(*keys, F.ceil(F.col("count") * PART / block).alias("blocks")), "large-buckets")
    n = large.count()
    if not n:
        return entries.withColumn("b", F.lit(0).cast("long"))
    listed = entries.join(F.broadcast(large) if n <= BROADCAST else large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks"))
    both = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)))
    return listed.withColumn("b", both).drop("blocks")
