"""Fetching documents and tiles, and checking endpoints, from tasks.

The fetch function is given by the caller, so tests use recorded answers: (url, headers, timeout) -> (status, content type,
body). Concurrency is the number of partitions. Sweeps never fail on an endpoint: errors are columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import urls
from mapweave.operators import adapters
from mapweave.operators.filters import imagery_candidates
from mapweave.operators.spatial import covering
from mapweave.schema import UNAVAILABLE, UNKNOWN, MapError
from mapweave.sources import featureinfo
from mapweave.sources.capabilities import wms_rows, wmts_rows

Fetch = Callable[[str, dict, float], tuple[int, str | None, bytes]]
ACCEPT = {"Accept": "application/xml,text/xml;q=0.9,*/*;q=0.5"}
CONCURRENCY, TIMEOUT, TILE_TIMEOUT, CLICK_TIMEOUT = 4, 10.0, 15.0, 8.0


def open_url(url: str, headers: dict, timeout: float) -> tuple[int, str | None, bytes]:
    """The plain fetch of the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310  URLs come from the catalogue
            return r.status, r.headers.get("content-type"), r.read()
    except HTTPError as e:
        return e.code, e.headers.get("content-type"), e.read()


def fetch(requests: DataFrame, get: Fetch = open_url, url: str = "url", headers: dict | None = None, timeout: float = TIMEOUT, concurrency: int = CONCURRENCY) -> DataFrame:
    """requests with status, content_type, body (binary), elapsed_ms, error and error_code. Each distinct URL is fetched once."""
    asked = requests.select(F.col(url).alias("__url")).filter("__url IS NOT NULL").distinct().repartition(concurrency)

    def each(batches):
        for batch in batches:
            rows = []
            for u in batch.column(0).to_pylist():
                began = time.monotonic()
                try:
                    status, kind, body = get(u, headers or {}, timeout)
                    bad = None if 200 <= status < 300 else f"{status} for {u}"
                    rows.append((u, status, kind, body, round((time.monotonic() - began) * 1000), bad, UNAVAILABLE if bad else None))
                except TimeoutError:
                    rows.append((u, None, None, None, round((time.monotonic() - began) * 1000), f"timed out after {timeout:g} s: {u}", UNAVAILABLE))
                except Exception as e:  # noqa: BLE001  any failure is a row
                    rows.append((u, None, None, None, round((time.monotonic() - began) * 1000), f"request to {u} failed: {e}", UNAVAILABLE))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            names = ["__url", "status", "content_type", "body", "elapsed_ms", "error", "error_code"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    got = asked.mapInArrow(each, "__url string, status int, content_type string, body binary, elapsed_ms long, error string, error_code string")
    return requests.join(got, F.col(url) == F.col("__url"), "left").drop("__url")


def capabilities(endpoints: DataFrame, get: Fetch = open_url, service: str = "WMS", version: str | None = None, proxy: str | None = None, **options) -> DataFrame:
    """endpoints (idx, url) with request_url and the fetched columns; body as text under xml."""
    asked = endpoints.withColumn("request_url", urls.through_proxy(urls.capabilities_url(F.col("url"), service, version), proxy))
    got = fetch(asked, get, "request_url", headers={**ACCEPT, **options.pop("headers", {})}, **options)
    return got.withColumn("xml", F.decode("body", "utf-8")).drop("body")


HEALTH = "ok boolean, version string, title string, layer_count int, queryable_count int, parse_error string, parse_code string"


def check(endpoints: DataFrame, get: Fetch = open_url, service: str = "WMS", parse: bool = True, **options) -> DataFrame:
    """A row an endpoint, in the order of idx: whether it answers, how fast, and what its document says."""
    got = capabilities(endpoints, get, service, **options)

    @F.pandas_udf(_struct(HEALTH))
    def read(errors, bodies):
        import pandas as pd

        rows = []
        for e, b in zip(errors, bodies, strict=True):
            if e is not None or not parse or service not in ("WMS", "WMTS"):
                rows.append((e is None, None, None, None, None, None, None))
                continue
            try:
                found = wms_rows(b) if service == "WMS" else wmts_rows(b)
                named = [r for r in found if r.get("name" if service == "WMS" else "identifier")]
                rows.append((True, found[0]["version"], found[0]["service"]["title"], len(named), sum(bool(r["queryable"]) for r in named), None, None))
            except MapError as error:
                rows.append((False, None, None, None, None, str(error), error.code))
            except Exception as error:  # noqa: BLE001
                rows.append((False, None, None, None, None, str(error), UNKNOWN))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in HEALTH.split(", ")])

    out = got.withColumn("r", read(F.col("error"), F.col("xml")))
    return out.select(
        "idx", "url", "request_url", "r.ok", "status", F.col("elapsed_ms").alias("response_time_ms"), "content_type", F.length("xml").alias("bytes"), F.lit(service).alias("service_type"), "r.version", "r.title",
        F.col("r.layer_count").alias("layer_count"), F.col("r.queryable_count").alias("queryable_layer_count"), F.coalesce("error", "r.parse_error").alias("error"), F.coalesce("error_code", "r.parse_code").alias("error_code"), F.current_timestamp().alias("checked_at"),
    ).orderBy("idx")


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def tiles(layers: DataFrame, wanted: DataFrame, get: Fetch = open_url, tile: int | None = None, **options) -> DataFrame:
    """wanted (id, z, x, y) with url, content_type and body; an answer that is no image is an error."""
    asked = wanted.join(layers.select("id", "service"), "id").withColumn("url", urls.tile_url(F.col("service"), F.col("x"), F.col("y"), F.col("z"), tile)).drop("service")
    got = fetch(asked, get, timeout=options.pop("timeout", TILE_TIMEOUT), **options)
    bad = F.col("error").isNull() & ~F.startswith(F.coalesce("content_type", F.lit("")), F.lit("image/"))
    return got.withColumn("error", F.when(bad, F.concat(F.lit("not an image: "), F.coalesce("content_type", F.lit("no type")))).otherwise(F.col("error"))).withColumn("body", F.when(F.col("error").isNull(), F.col("body")))


def clicks(layers: DataFrame, points: DataFrame, get: Fetch = open_url, **options) -> DataFrame:
    """Feature information of the queryable WMS layers of the stack at each point (lng, lat), the most local first: parsed answers worth showing."""
    asked = covering(points, layers.filter("service.type = 'WMS' AND service.wms.queryable").select("id", "ord", "area_km2", "extents", "service"))
    asked = asked.withColumn("url", urls.feature_info_url(F.col("service.url"), F.col("service.wms"), F.col("lng"), F.col("lat"))).drop("service", "extents")
    got = fetch(asked, get, timeout=options.pop("timeout", CLICK_TIMEOUT), **options).filter("error IS NULL").withColumn("body", F.decode("body", "utf-8"))
    return featureinfo.with_answers(featureinfo.parse(got)).orderBy("area_km2", "ord").drop("area_km2")


def cached_tiles(wanted: DataFrame, cache: DataFrame, get: Fetch = open_url, **options) -> tuple[DataFrame, DataFrame]:
    """wanted (url) with content_type, body and from_cache; and the entries to write behind: what was fetched and is an image.

    cache: url, content_type, body, inserted_at; trim it with state.cache_keep.
    """
    known = wanted.join(cache.select("url", F.col("content_type").alias("kept_type"), F.col("body").alias("kept")), "url", "left")
    got = fetch(known.filter("kept IS NULL").drop("kept", "kept_type"), get, timeout=options.pop("timeout", TILE_TIMEOUT), **options)
    image = F.col("error").isNull() & F.startswith(F.coalesce("content_type", F.lit("")), F.lit("image/"))
    fresh = got.withColumn("body", F.when(image, F.col("body"))).select(*wanted.columns, "content_type", "body", F.lit(False).alias("from_cache"))
    held = known.filter("kept IS NOT NULL").select(*wanted.columns, F.col("kept_type").alias("content_type"), F.col("kept").alias("body"), F.lit(True).alias("from_cache"))
    entries = fresh.filter("body IS NOT NULL").select("url", "content_type", "body").dropDuplicates(["url"]).withColumn("inserted_at", F.current_timestamp())
    return held.unionByName(fresh), entries


def protocol_tiles(asked: DataFrame, layers: DataFrame, get: Fetch = open_url, **options) -> DataFrame:
    """asked (url of our own scheme) with id, z, x, y, content_type, body and error: URL to layer to request to bytes."""
    named = asked.withColumn("own", adapters.parse_own(F.col("url")))
    known = named.select("url", "own.*").join(layers.select("id"), "id", "left_semi")
    got = tiles(layers, known.select("id", "z", "x", "y").distinct(), get, **options).select("id", "z", "x", "y", "content_type", "body", "error")
    out = named.select(F.col("url"), "own.id", "own.z", "own.x", "own.y").join(got, ["id", "z", "x", "y"], "left").join(layers.select("id", F.lit(True).alias("there")), "id", "left")
    missing = F.when(F.col("id").isNull(), "not a tile URL").when(F.col("there").isNull(), F.concat(F.lit("no such layer: "), "id"))
    return out.withColumn("error", F.coalesce(missing, "error")).drop("there")


def mosaic_tiles(asked: DataFrame, chain: DataFrame, layers: DataFrame, get: Fetch = open_url, **options) -> DataFrame:
    """asked (url of a mosaic) with z, x, y, served_by, content_type, body and cache_control.

    chain: mosaic.select's rows (z, x, y, nth, id). Tiles are asked of their first source, those that fail of the next one, and so on
    down the longest list; what is left is a hole, drawn empty and not to be stored. A round's answers are written by the caller's
    session as they are needed; there are as many rounds as sources to a tile.
    """
    named = asked.withColumn("own", adapters.parse_own(F.col("url"))).select("url", "own.z", "own.x", "own.y")
    left = named.select("z", "x", "y").distinct()
    chain = chain.join(left, ["z", "x", "y"], "left_semi").persist()
    served = None
    for nth in range(1, (chain.agg(F.max("nth")).first()[0] or 0) + 1):
        now = chain.filter(F.col("nth") == nth).join(left, ["z", "x", "y"], "left_semi")
        got = tiles(layers, now.select("id", "z", "x", "y"), get, **options).filter("error IS NULL").select("z", "x", "y", F.col("id").alias("served_by"), "content_type", "body").persist()
        served = got if served is None else served.unionByName(got)
        left = left.join(got, ["z", "x", "y"], "left_anti")
    if served is None:
        return named.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("served_by", "string"), ("content_type", "string"), ("body", "binary"))], F.lit("no-store").alias("cache_control"))
    return named.join(served, ["z", "x", "y"], "left").withColumn("cache_control", F.when(F.col("served_by").isNull(), "no-store"))


def probe_requests(layers: DataFrame) -> DataFrame:
    """One tile at the middle of every drawable layer, at a zoom it should have."""
    from mapweave.functions.boxes import Box
    from mapweave.functions.mercator import tile_of

    lng, lat = Box.of("bbox").center()
    z = F.least(F.greatest(F.col("minZoom") + 4, F.lit(8)), F.col("maxZoom"), F.lit(16))
    x, y = tile_of(lng, lat, z)
    return imagery_candidates(layers, True, ()).select("id", z.alias("z"), x.alias("x"), y.alias("y"))
