"""Text as columns: numbers as scripts print them, slugs, entities, credits."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def number(x: Column, precision: int | None = None) -> Column:
    """Shortest decimal form without exponent: whole numbers have no point, minus zero no sign. With precision so many digits."""
    if precision is not None:
        return F.format_string(f"%.{precision}f", x)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    return F.when(x.isNull(), F.lit(None)).when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(F.call_function("format_number", x, F.lit("0.################")))


@F.arrow_udf(StringType())
def without_marks(texts: pa.Array) -> pa.Array:
    """Canonical decomposition less its combining marks; Spark has no function for it."""
    out = []
    for t in texts.to_pylist():
        if t is not None and not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M"))
        out.append(t)
    return pa.array(out, pa.string())


def slug(text: Column, ascii_only: bool = False) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, 60 characters at most. ascii_only: the text has no marks, so no UDF is needed."""
    plain = F.lower(text if ascii_only else without_marks(text))
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(dashed, 1, 60)


def layer_id(*parts: Column, ascii_only: bool = False) -> Column:
    return F.array_join(F.filter(F.array(*[slug(p, ascii_only) for p in parts]), lambda p: p != ""), ".")


def decode_entities(text: Column) -> Column:
    """The common entities; the ampersand comes last, so nothing is decoded twice."""
    # The entities and what they stand for.
    for pattern, to in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#0?39;", "'"), ("(?i)&apos;", "'"), ("(?i)&amp;", "&")):
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_tags(text: Column) -> Column:
    return F.trim(decode_entities(F.regexp_replace(text, "<[^>]*>", "")))


def credit(html: bool = True, with_license: bool = True) -> Column:
    """The credit line of a layer row, with links if html; the licence is left out if unknown."""

    def linked(label: Column, url: Column) -> Column:
        if not html:
            return label
        link = F.concat(F.lit('<a href="'), url, F.lit('" target="_blank" rel="noopener">'), label, F.lit("</a>"))
        return F.when(F.coalesce(url, F.lit("")) != "", link).otherwise(label)

    who = linked(F.col("attribution"), F.col("provider.url"))
    if not with_license:
        return who
    terms = linked(F.coalesce("license.name", "license.id"), F.col("license.url"))
    return F.when(F.col("license.id") == "unknown", who).otherwise(F.concat(who, F.lit(" ("), terms, F.lit(")")))


def credits(layers: DataFrame, by: list[str] | None = None, html: bool = True, with_license: bool = True) -> DataFrame:
    """Distinct credit lines in catalogue order, joined by bars; one row for each group of `by`."""
    listed = F.sort_array(F.collect_list(F.struct("ord", credit(html, with_license).alias("text"))))
    return layers.groupBy(*(by or [])).agg(F.array_join(F.array_distinct(F.transform(listed, lambda x: x["text"])), " | ").alias("attribution"))
