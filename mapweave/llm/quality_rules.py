"""Quality rules from hashed n-gram log-likelihood ratios, in DataFrame functions only.

Words and pairs of neighbouring words of every text are hashed into 2**BITS buckets. One multinomial over the buckets is
counted on the whole raw corpus, another on trusted documents; a bucket's weight is the logarithm of their ratio, the
trusted one being smoothed by the raw one. A document's score is the mean weight of its n-grams, so length is normalised.
Weights are whole numbers (millionths), so sums don't depend on the order in which they are added.

Documents below a threshold are rejected. Half of the trusted documents, which the multinomial has not seen, set it: a low
quantile of their scores less a margin. Few trusted documents give coarse multinomials and widely spread scores, so the
threshold gives way, and clean documents are kept, at any size; without trusted documents only the base rules act.

Before that come base rules: fewer than 50 words, or over half of the words in repeated windows of three words.

All trusted documents count. Their keys meet the documents by a broadcast while they are BROADCAST rows at most, else by a
shuffled join. The table of weights has 2**BITS entries and stands in the plan as a constant.
Null texts have no words. Repeated rows, ties and extra columns need no care; results come in one struct column. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import text_or_empty

BITS = 16
BROADCAST = 500_000
#: Share of clean documents that may fall below the quantile, and what the threshold lies below it (in millionths of a nat).
LOW_SHARE, MARGIN = 0.002, 50_000
#: The six white-space characters between words, and the symbols that are counted.
BREAKS, GAPS, SYMBOLS = " \t\n\x0b\f\r", "[ \\t\\n\\x0B\\f\\r]+", "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _up_to(last: Column) -> Column:
    """0 to last as an array, empty below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _chained(hashes: Column) -> Column:
    """Hashes of all two neighbours: of words they are those of pairs, of pairs those of windows of three words."""
    n = F.size(hashes) - 1
    linked = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda x, y: F.xxhash64(x, y))
    return F.when(n > 0, linked).otherwise(F.array().cast("array<bigint>"))


def _ordered(windows: Column) -> Column:
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(s: Column) -> Column:
    """Positions, in order, of windows that stand beside an equal one in the ordered array s."""
    last = F.size(s) - 1
    same = F.filter(
        _up_to(last),
        lambda j: ((j > 0) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"])) | ((j < last) & (F.get(s, j)["h"] == F.get(s, j + 1)["h"])),
    )
    return F.sort_array(F.transform(same, lambda j: F.get(s, j)["i"]))


def _covered(p: Column) -> Column:
    """Words in windows that begin at the positions p: three for each, less overlaps."""
    last = F.size(p) - 1
    return F.aggregate(_up_to(last), F.lit(0), lambda n, k: n + F.when(k < last, F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k))).otherwise(3))


def _buckets(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))


def _grams(hashes: Column) -> Column:
    return F.concat(_buckets(hashes), _buckets(_chained(hashes)))


def _weight_sum(hashes: Column, weights: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.get(weights, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))


def _score_sum(hashes: Column, pairs: Column, weights: Column) -> Column:
    """Sum of weights over the words and the pairs. One pass over both, so the table of weights stands in the plan once."""
    return _weight_sum(F.concat(hashes, pairs), weights)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("held", F.transform(words_of(text_or_empty(text)), lambda w: F.xxhash64(w)).alias("h"))


def trusted_keys(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Keys of trusted documents (marked 1 in all of their labels), and whether they set the threshold."""
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.min(quality).alias("q")).filter("q = 1").select("k")
    return good.withColumn("held", F.xxhash64(F.col("k"), F.lit(1)).bitwiseAND(F.lit(1)) == 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST) -> tuple[list[int], int]:
    """Weights of the buckets, and the threshold; both in millionths."""
    trusted, texts = trusted_keys(labels, key), docs.select(F.col(key).cast("long").alias("k"), text)
    if trusted.count() <= broadcast_rows:
        trusted = F.broadcast(trusted)
        marked = texts.join(trusted, "k", "left")
    else:  # null keys would all meet in one task
        nothing = texts.filter("k IS NULL").withColumn("held", F.lit(None).cast("boolean"))
        marked = texts.filter("k IS NOT NULL").join(trusted, "k", "left").unionByName(nothing)
    counted = (
        _hashed(marked, text).select(F.explode(_grams(F.col("h"))).alias("bucket"), (F.col("held") == F.lit(False)).alias("target"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("target").alias("target"))
        .agg(F.collect_list(F.struct("bucket", "raw", "target")).alias("all")).select("all.bucket", "all.raw", "all.target").first()
    )
    n = 1 << BITS
    raw, target = [1] * n, [0] * n
    for bucket, a, b in zip(*counted, strict=True):  # three lists of numbers, not a row a bucket
        raw[bucket] += a
        target[bucket] += b
    raw_sum, target_sum = sum(raw), sum(target)
    if not target_sum:
        return [0] * n, -(1 << 62)
    weights = [round(1e6 * math.log((t + n * r / raw_sum) / (target_sum + n) / (r / raw_sum))) for r, t in zip(raw, target, strict=True)]
    # the join comes first, so that only its rows are hashed
    held = _hashed(texts.join(trusted.filter("held"), "k"), text).filter(F.size("h") >= 50)
    mean = F.floor(_score_sum(F.col("h"), _chained(F.col("h")), constant(weights)) / (2 * F.size("h") - 1) / 1000)
    spread = sorted((r["at"], r["n"]) for r in held.select(mean.alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect())
    below, allowed = 0, LOW_SHARE * sum(k for _, k in spread)
    for at, k in spread:
        below += k
        if below > allowed:
            return weights, at * 1000 - MARGIN
    return weights, -(1 << 62)


def constant(weights: list[int]) -> Column:
    """The table of weights as one constant of the plan."""
    return F.from_json(F.lit(f"[{','.join(map(str, weights))}]"), "array<int>")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used; plain columns would be computed anew wherever a filter is pushed down to."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def verdict(text: Column, weights: list[int], threshold: int) -> Column:
    """A struct of the base columns, base_failed, kept and the score (llr, in nats an n-gram) of a text."""

    def of_hashes(words: Column, h: Column, pairs: Column, lines: Column) -> Column:
        n = F.size(h)
        repeated = _let(_chained(pairs), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(_ordered(w), lambda s: _let(_repeated(s), _covered))).otherwise(0))
        parts = F.struct(
            n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"),
            _score_sum(h, pairs, constant(weights)).alias("sum"), F.greatest(2 * n - 1, F.lit(1)).alias("grams"),
        )
        return _let(parts, of_parts)

    def of_parts(p: Column) -> Column:
        failed = (p["n_words"] < 50) | (100 * p["n_repeat_words"] > 50 * p["n_words"])
        return F.struct(
            *[p[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"),
            (~failed & (p["sum"] >= F.lit(threshold).cast("decimal(20,0)") * p["grams"])).alias("kept"), (p["sum"] / 1e6 / p["grams"]).alias("llr"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BREAKS)) != "")
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    return _let(words_of(text), lambda w: _let(hashes(w), lambda h: _let(_chained(h), lambda p: _let(lines, lambda x: of_hashes(w, h, p, x)))))


def judge(docs: DataFrame, weights: list[int], threshold: int, text: str = "text", into: str = "quality_rules") -> DataFrame:
    """docs with the verdict in a struct column."""
    return docs.withColumn(into, verdict(text_or_empty(text), weights, threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", into: str = "quality_rules") -> DataFrame:
    weights, threshold = fit(docs, labels, key, text)
    return judge(docs, weights, threshold, text, into)
