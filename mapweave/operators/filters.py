"""Looking up and filtering layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import boxes, nuts
from mapweave.functions.boxes import Box
from mapweave.functions.services import is_queryable


def get(layers: DataFrame, id: str) -> DataFrame:
    return layers.filter(F.col("id") == id)


def get_many(layers: DataFrame, ids: list[str]) -> DataFrame:
    """In the order asked, as often as asked; unknown ids are dropped. pos: the place in the list."""
    asked = layers.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return join_ids(layers, asked).orderBy("pos")


def join_ids(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for a table of (pos, id)."""
    return asked.join(layers, "id")


def _many(value) -> list:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


@dataclass(frozen=True)
class Query:
    """Criteria that must all hold; None, empty strings and empty lists don't filter (queryable=False does)."""

    country: str | None = None
    nuts: str | None = None
    category: str | list[str] | None = None
    service: str | list[str] | None = None
    status: str | list[str] | None = None
    tags: tuple[str, ...] = ()
    text: str | None = None
    point: tuple[float, float] | None = None
    bbox: tuple[float, float, float, float] | None = None
    queryable: bool | None = None
    zoom: float | None = None

    def condition(self) -> Column:
        """Scalar tests come first, so that they can be pushed to the scan."""
        tests: list[Column] = []
        if self.country:
            tests.append(F.col("country") == self.country)
        for column, value in (("category", self.category), ("service.type", self.service), ("status", self.status)):
            if _many(value):
                tests.append(F.col(column).isin(*_many(value)))
        if self.zoom is not None:
            tests.append((F.col("minZoom") <= self.zoom) & (F.col("maxZoom") >= self.zoom))
        if self.nuts:
            scope = F.coalesce(F.col("nuts"), nuts.of_country(F.col("country")))
            tests.append(F.coalesce(nuts.within(scope, F.lit(self.nuts)), F.lit(False)))
        if self.tags:
            tests.append(F.size(F.array_except(F.array(*[F.lit(t) for t in self.tags]), F.col("tags"))) == 0)
        if self.queryable is not None:
            tests.append(is_queryable() == F.lit(self.queryable))
        if self.point:
            tests.append(boxes.any_contains(F.col("extents"), F.lit(float(self.point[0])), F.lit(float(self.point[1]))))
        if self.bbox:
            tests.append(boxes.any_overlaps(F.col("extents"), Box.at(self.bbox)))
        if self.text and self.text.strip():
            tests.append(F.contains(haystack(), F.lit(self.text.strip().lower())))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def haystack(with_description: bool = True) -> Column:
    """What free text is searched in; missing fields leave their space."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = ["id", "title", *(["description"] if with_description else []), "regionName", "provider.name"]
    return F.lower(F.concat_ws(" ", *[empty(c) for c in fields], F.col("tags")))


def find(layers: DataFrame, query: Query) -> DataFrame:
    """Matching layers; sort by ord for catalogue order."""
    return layers.filter(query.condition())


def search(layers: DataFrame, words: str) -> DataFrame:
    """Free text as the layer list searches it: without descriptions."""
    return layers.filter(F.contains(haystack(with_description=False), F.lit(words.strip().lower())))


def imagery_candidates(layers: DataFrame, include_inactive: bool = False, excluded_tags: tuple[str, ...] = ("alternative",)) -> DataFrame:
    """Imagery that a mosaic may draw."""
    out = layers.filter(F.col("category").isin("orthophoto", "satellite") & ~F.col("service.type").isin("WFS", "COG"))
    if not include_inactive:
        out = out.filter("status = 'active'")
    if excluded_tags:
        out = out.filter(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in excluded_tags])))
    return out
