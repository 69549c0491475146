"""The registered queries over the derived layers, points, outlines and logs, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.functions import boxes, mercator, nuts, text, urls
from mapweave.functions.boxes import Box
from mapweave.functions.crs import REGISTRY
from mapweave.functions.services import can_stitch, click_problem, info_formats, is_queryable, is_raster, is_visible_at, needs_reprojection
from mapweave.operators import adapters, aggregates, audit, country, filters, mosaic, pixels, ranking, spatial
from mapweave.operators.filters import Query
from mapweave.plans import samples
from mapweave.plans.derived import FALLBACK, layers, nation_codes, outlines, points, table, tile_log
from mapweave.sources import capabilities, collections, featureinfo
from mapweave.sources import outlines as outline_source
from mapweave.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CODES = ", ".join(f"({k}, '{iso}', '{n}')" for k, iso, n in nation_codes())
_ISO_OF = ", ".join(f"('{n}', '{i}')" for n, i, _ in nuts.COUNTRIES)
_CTE = {
    "codes": f"codes(nk, iso, nuts0) AS (VALUES {_CODES})",
    "pts": "pts AS (SELECT c_custkey AS pid, iso AS country_here, c_custkey*7919 % 70000 / 1000 - 25 AS lng, c_custkey*104729 % 38000 / 1000 + 34 AS lat FROM customer JOIN codes ON c_nationkey = nk)",
    "lay": """lay0 AS (SELECT s_suppkey AS k, s_name, iso AS country, nuts0, s_suppkey*37 % 600 / 10 - 25 AS w, s_suppkey*53 % 330 / 10 + 34 AS s FROM supplier JOIN codes ON s_nationkey = nk),
lay1 AS (SELECT *, w + 2 + k % 9 AS e, s + 1 + k % 5 AS n FROM lay0),
ext AS (SELECT k, w, s, e, n FROM lay1 WHERE k % 6 <> 0 UNION ALL SELECT k, w, s, w + (e-w)/4, n FROM lay1 WHERE k % 6 = 0 UNION ALL SELECT k, e - (e-w)/4, s, e, n FROM lay1 WHERE k % 6 = 0),
area AS (SELECT k, round(sum((e-w)*111.32*cos(radians((s+n)/2))*(n-s)*111.32), 6) AS area_km2 FROM ext GROUP BY k),
lay AS (SELECT l.*, 'l.' || lpad(k::VARCHAR, 6, '0') AS id, area_km2, coalesce(p_name, 'untitled') AS title, p_type AS description, p_brand AS region_name,
  CASE WHEN k % 5 = 0 THEN 'satellite' WHEN k % 5 = 4 THEN 'cadastre' ELSE 'orthophoto' END AS category, CASE WHEN k % 11 = 0 THEN 'experimental' ELSE 'active' END AS status,
  CASE WHEN k % 17 = 0 THEN 'WFS' WHEN k % 4 = 0 THEN 'WMTS' WHEN k % 4 = 1 THEN 'XYZ' ELSE 'WMS' END AS type,
  CASE WHEN k % 7 <> 0 AND country <> 'EU' THEN nuts0 || (1 + k % 4)::VARCHAR || CASE WHEN k % 2 = 1 THEN (1 + k % 3)::VARCHAR ELSE '' END END AS nuts,
  list_filter([CASE WHEN k % 13 = 0 THEN 'alternative' END, CASE WHEN k % 2 = 0 THEN 'rgb' END, CASE WHEN k % 3 = 0 THEN '20cm' END], lambda t: t IS NOT NULL) AS tags,
  k % 8 AS min_zoom, 14 + k % 9 AS max_zoom, (1 + k % 7) / 10 AS resolution, '2026-0' || (1 + k % 9)::VARCHAR || '-1' || (k % 10)::VARCHAR AS last_verified, 'Provider ' || (k % 12)::VARCHAR AS attribution,
  CASE WHEN k % 3 = 0 THEN 'CC-BY-4.0' WHEN k % 3 = 1 THEN 'custom' ELSE 'unknown' END AS license_id
  FROM lay1 l JOIN area USING (k) LEFT JOIN part ON p_partkey = k),
lay_q AS (SELECT *, type = 'WFS' OR (type IN ('WMS', 'WMTS') AND k % 3 = 1) AS queryable FROM lay)""",
    "cov": "cov AS (SELECT DISTINCT p.pid, p.country_here, l.* FROM pts p JOIN ext x ON p.lng BETWEEN x.w AND x.e AND p.lat BETWEEN x.s AND x.n JOIN lay l ON l.k = x.k)",
    "log": """log AS (SELECT event_id AS seq, ts, 'l.' || lpad((user_id % 20)::VARCHAR, 6, '0') AS layer_id, (12 + event_id % 4)::INT AS z, 2000 + event_id*31 % 40 AS x, 1400 + event_id*17 % 40 AS y,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'blank' ELSE 'served' END AS outcome FROM events)""",
}


def sql(body: str, *parts: str) -> str:
    """body behind the common tables it needs."""
    needed = [p for p in _CTE if p in parts or (p == "codes" and {"pts", "lay", "cov"} & {*parts}) or (p in ("pts", "lay") and "cov" in parts)]
    return f"WITH RECURSIVE {', '.join(_CTE[p] for p in needed)} {body}" if needed else body


def query(oracle: str | None = None, *parts: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *parts)
        return f

    return register


# Ranking of sources for points


@query("SELECT pid, coalesce((SELECT id FROM cov WHERE cov.pid = pts.pid AND category = 'orthophoto' AND status = 'active' AND NOT list_contains(tags, 'alternative') ORDER BY area_km2, k LIMIT 1), 'l.000005') AS best FROM pts", "cov")
def best_source(spark, sf):
    return ranking.best_source(points(spark, sf), layers(spark, sf), ["pid"], FALLBACK)


@query("SELECT pid, coalesce((SELECT id FROM cov WHERE cov.pid = pts.pid AND category = 'orthophoto' AND status = 'active' AND NOT list_contains(tags, 'alternative') AND country IN (pts.country_here, 'EU') ORDER BY area_km2, k LIMIT 1), 'l.000005') AS best FROM pts", "cov")
def best_source_in_country(spark, sf):
    p = points(spark, sf)
    return ranking.best_source(p, layers(spark, sf), ["pid"], FALLBACK, "country_here")


@query("""SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY part, area_km2, k) AS nth, id FROM (
  SELECT pid, id, CASE WHEN country IN (country_here, 'EU') THEN 0 ELSE 2 END AS part, area_km2, k FROM cov WHERE category IN ('orthophoto', 'satellite') AND status = 'active' AND NOT list_contains(tags, 'alternative') AND id <> 'l.000005'
  UNION ALL SELECT pid, 'l.000005', 1, 0, 0 FROM pts)""", "cov")
def imagery_stack(spark, sf):
    return ranking.imagery_stack(points(spark, sf), layers(spark, sf), ["pid"], FALLBACK, "country_here")


@query("SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY area_km2, k) AS nth, id, area_km2 FROM cov WHERE status = 'active' AND min_zoom <= 6 AND max_zoom >= 6", "cov")
def layers_for_point(spark, sf):
    return ranking.layers_for_points(points(spark, sf), layers(spark, sf), ["pid"], Query(zoom=6), ["id", "area_km2"]).select("pid", "nth", "id", "area_km2")


@query("SELECT pid, id FROM cov", "cov")
def covering_grid(spark, sf):
    """The range join by grid cells, which needs no broadcast."""
    return spatial.covering_grid(points(spark, sf), layers(spark, sf)).select("pid", "id")


# Filters


def _find(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: filters.find(layers(spark, sf), q).select("id", "ord")


_FOUND = "SELECT id, k AS ord FROM lay_q WHERE "
for _name, _q, _where in [
    ("find_by_country", Query(country="DE"), "country = 'DE'"),
    ("find_by_category", Query(category=["orthophoto", "cadastre"], status="active"), "category IN ('orthophoto', 'cadastre') AND status = 'active'"),
    ("find_by_service", Query(service=["WMS", "WFS"]), "type IN ('WMS', 'WFS')"),
    ("find_by_tags", Query(tags=("rgb", "20cm")), "list_contains(tags, 'rgb') AND list_contains(tags, '20cm')"),
    ("find_by_text", Query(text="  L.00000 "), "contains(lower(concat_ws(' ', id, title, coalesce(description, ''), coalesce(region_name, ''), s_name, array_to_string(tags, ' '))), 'l.00000')"),
    ("find_by_zoom", Query(zoom=17), "min_zoom <= 17 AND max_zoom >= 17"),
    ("find_by_nuts", Query(nuts="DE1"), "starts_with(coalesce(nuts, nuts0), 'DE1')"),
    ("find_by_country_region", Query(nuts="EL"), "starts_with(coalesce(nuts, nuts0), 'EL')"),
    ("find_by_bbox", Query(bbox=(5.0, 43.0, 9.0, 47.0)), "k IN (SELECT k FROM ext x WHERE x.s <= 47 AND 43 <= x.n AND x.w <= 9 AND 5 <= x.e)"),
    ("find_by_point", Query(point=(9.5, 45.0)), "k IN (SELECT k FROM ext x WHERE 9.5 BETWEEN x.w AND x.e AND 45 BETWEEN x.s AND x.n)"),
    ("find_queryable", Query(queryable=True), "queryable"),
    ("find_not_queryable", Query(queryable=False, country=""), "NOT queryable"),
    ("find_all_criteria", Query(category="orthophoto", status="active", zoom=8, queryable=True, tags=("rgb",), text="a"), "category = 'orthophoto' AND status = 'active' AND min_zoom <= 8 AND max_zoom >= 8 AND queryable AND list_contains(tags, 'rgb') AND contains(lower(concat_ws(' ', id, title, coalesce(description, ''), coalesce(region_name, ''), s_name)), 'a')"),
]:
    QUERIES[_name], ORACLES[_name] = _find(_q), sql(_FOUND + _where, "lay")


@query("SELECT id FROM lay WHERE contains(lower(concat_ws(' ', id, title, coalesce(region_name, ''), s_name, array_to_string(tags, ' '))), 'rgb')", "lay")
def search_list(spark, sf):
    return filters.search(layers(spark, sf), " RGB ").select("id")


@query("SELECT id, title FROM lay WHERE id = 'l.000007'", "lay")
def get_layer(spark, sf):
    return filters.get(layers(spark, sf), "l.000007").select("id", "title")


@query("SELECT pos, lay.id, title FROM (VALUES (0, 'l.000009'), (1, 'l.000002'), (2, 'l.000009'), (3, 'nowhere')) a(pos, id) JOIN lay ON lay.id = a.id", "lay")
def multi_get(spark, sf):
    return filters.get_many(layers(spark, sf), ["l.000009", "l.000002", "l.000009", "nowhere"]).select("pos", "id", "title")


@query("""SELECT id, queryable, type <> 'WFS' AS raster, type = 'WMS' AND k % 5 = 0 AS reprojected, type IN ('WMTS', 'XYZ') AS stitchable,
  CASE WHEN type = 'WMS' THEN 'text/plain,text/html' WHEN type = 'WFS' THEN 'application/json' ELSE '' END AS formats, type = 'WMS' AND k % 3 = 1 AS clickable FROM lay_q""", "lay")
def service_guards(spark, sf):
    return layers(spark, sf).select("id", is_queryable().alias("queryable"), is_raster().alias("raster"), needs_reprojection().alias("reprojected"), can_stitch().alias("stitchable"), F.array_join(info_formats(), ",").alias("formats"), click_problem().isNull().alias("clickable"))


@query("SELECT id FROM lay WHERE category IN ('orthophoto', 'satellite') AND type <> 'WFS' AND status = 'active' AND NOT list_contains(tags, 'alternative')", "lay")
def mosaic_candidates(spark, sf):
    return filters.imagery_candidates(layers(spark, sf)).select("id")


# Boxes that meet layers, and the audit of overlaps

_AREA = "areas AS (SELECT pid, lng AS w, lat AS s, lng + 1 AS e, lat + 0.5 AS n FROM pts)"


def _areas(spark, sf):
    return points(spark, sf).select("pid", Box(F.col("lng"), F.col("lat"), F.col("lng") + 1, F.col("lat") + 0.5).struct().alias("area"))


@query(f", {_AREA} SELECT DISTINCT pid, id FROM areas a JOIN ext x ON a.s <= x.n AND x.s <= a.n AND a.w <= x.e AND x.w <= a.e JOIN lay USING (k)", "pts", "lay")
def extent_overlap(spark, sf):
    return spatial.overlapping(_areas(spark, sf), layers(spark, sf)).select("pid", "id")


@query(f", {_AREA} SELECT DISTINCT pid, id FROM areas a JOIN ext x ON a.w BETWEEN x.w AND x.e AND a.e BETWEEN x.w AND x.e AND a.s BETWEEN x.s AND x.n AND a.n BETWEEN x.s AND x.n JOIN lay USING (k)", "pts", "lay")
def extent_contains(spark, sf):
    return spatial.containing(_areas(spark, sf), layers(spark, sf)).select("pid", "id")


_CONTESTED = """, im AS (SELECT *, (e-w)*111.32*cos(radians((s+n)/2))*(n-s)*111.32 AS hull FROM lay WHERE status = 'active' AND category = 'orthophoto'),
pairs AS (SELECT a.k AS ka, b.k AS kb, a.hull < b.hull AS first_small, a.id AS ia, b.id AS ib, a.country AS ca, b.country AS cb, greatest(a.w, b.w) AS w, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, least(a.n, b.n) AS n
  FROM im a JOIN im b ON a.k < b.k AND least(a.e, b.e) > greatest(a.w, b.w) AND least(a.n, b.n) > greatest(a.s, b.s) AND (a.country <> b.country OR a.nuts IS DISTINCT FROM b.nuts)),
grid AS (SELECT p.*, w + (e - w) * i / 12 AS lng, s + (n - s) * j / 12 AS lat FROM pairs p, range(13) r(i), range(13) q(j)),
hits AS (SELECT ka, kb, count(*) AS contested FROM grid g WHERE EXISTS (SELECT 1 FROM ext x WHERE x.k = ka AND lng BETWEEN x.w AND x.e AND lat BETWEEN x.s AND x.n) AND EXISTS (SELECT 1 FROM ext x WHERE x.k = kb AND lng BETWEEN x.w AND x.e AND lat BETWEEN x.s AND x.n) GROUP BY ka, kb),
found AS (SELECT CASE WHEN first_small THEN ia ELSE ib END AS winner, CASE WHEN first_small THEN ib ELSE ia END AS loser, ca <> cb AS cross_border, contested FROM hits JOIN pairs USING (ka, kb)) """


def _audited(spark, sf):
    return audit.contested(filters.find(layers(spark, sf), Query(category="orthophoto", status="active")))


@query(_CONTESTED + "SELECT winner, loser, cross_border, contested, round(contested / 169, 3) AS contested_share FROM found", "lay")
def contested_grid(spark, sf):
    return _audited(spark, sf).select("winner", "loser", "cross_border", F.col("contested").cast("long").alias("contested"), "contested_share")


@query(_CONTESTED + "SELECT winner, count(*) AS conflicts, count(*) FILTER (cross_border) AS cross_border FROM found GROUP BY winner", "lay")
def winner_conflicts(spark, sf):
    return audit.by_winner(_audited(spark, sf)).drop("narrowed")


@query(_CONTESTED + "SELECT winner, loser, round(contested / 169, 3) AS contested_share FROM found ORDER BY contested_share DESC, winner, loser", "lay")
def findings_by_share(spark, sf):
    return audit.in_order(_audited(spark, sf)).select("winner", "loser", "contested_share")


# Countries from outlines

_OUTLINES = """, mid AS (SELECT nk, iso, nk*37 % 60 - 20 AS cx, nk*23 % 30 + 38 AS cy, 2 + nk % 4 AS r FROM nation JOIN codes ON n_nationkey = nk),
ring AS (SELECT nk, iso, 0 AS ring, i, cx + r * a / 4 AS x, cy + r * b / 4 AS y FROM mid, (VALUES (0, 4, 0), (1, 3, 3), (2, 0, 4), (3, -3, 2), (4, -4, 0), (5, -2, -3), (6, 0, -4), (7, 3, -2)) c(i, a, b)
  UNION ALL SELECT nk, iso, 1, i, cx + a / 4, cy + b / 4 FROM mid, (VALUES (0, -2, -2), (1, 2, -2), (2, 2, 2), (3, -2, 2)) c(i, a, b) WHERE nk % 3 = 0),
edges AS (SELECT nk, iso, ring, x AS qx, y AS qy, coalesce(lag(x) OVER q, last_value(x) OVER (PARTITION BY nk, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px,
  coalesce(lag(y) OVER q, last_value(y) OVER (PARTITION BY nk, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py FROM ring WINDOW q AS (PARTITION BY nk, ring ORDER BY i)),
crossed AS (SELECT pid, nk, iso, ring, count(*) FILTER ((qy > lat) <> (py > lat) AND lng < (px - qx) * (lat - qy) / (py - qy) + qx) % 2 = 1 AS inside FROM pts, edges GROUP BY pid, nk, iso, ring),
strict AS (SELECT pid, arg_min(iso, nk) AS country FROM (SELECT pid, nk, iso, bool_or(inside AND ring = 0) AS within, bool_or(inside AND ring = 1) AS in_hole FROM crossed GROUP BY pid, nk, iso) WHERE within AND NOT in_hole GROUP BY pid)"""


@query(_OUTLINES + " SELECT pid, country FROM pts LEFT JOIN strict USING (pid)", "pts")
def country_at_strict(spark, sf):
    return country.country_at(points(spark, sf), outlines(spark, sf), ["pid"], 0).select("pid", "country")


@query(_OUTLINES + """, hull AS (SELECT nk, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ring WHERE ring = 0 GROUP BY nk),
near AS (SELECT pid, nk, iso, min(pow(wx - t*dx, 2) + pow(wy - t*dy, 2)) AS d FROM (SELECT *, CASE WHEN dx*dx + dy*dy > 0 THEN greatest(0.0, least(1.0, (wx*dx + wy*dy) / (dx*dx + dy*dy))) ELSE 0.0 END AS t FROM (
  SELECT pid, nk, iso, (qx - px) * cos(radians(lat)) AS dx, qy - py AS dy, (lng - px) * cos(radians(lat)) AS wx, lat - py AS wy FROM pts, edges JOIN hull USING (nk) WHERE ring = 0 AND lng BETWEEN x0 - 60.0/111 AND x1 + 60.0/111 AND lat BETWEEN y0 - 60.0/111 AND y1 + 60.0/111)) GROUP BY pid, nk, iso),
best AS (SELECT pid, arg_min(iso, struct_pack(d := round(d, 12), nk := nk)) AS iso, min(d) AS d FROM near GROUP BY pid)
SELECT pid, coalesce(country, CASE WHEN d <= pow(60.0/111, 2) THEN iso END) AS country FROM pts LEFT JOIN strict USING (pid) LEFT JOIN best USING (pid)""", "pts")
def country_at_tolerant(spark, sf):
    return country.country_at(points(spark, sf), outlines(spark, sf), ["pid"], 60).select("pid", "country")


@query("SELECT iso FROM nation JOIN codes ON n_nationkey = nk", "codes")
def bounded_countries(spark, sf):
    return country.bounded_countries(outlines(spark, sf))


@query(_OUTLINES + " SELECT pid, coalesce(country = 'DE', false) AS inside FROM pts LEFT JOIN strict USING (pid)", "pts")
def in_country(spark, sf):
    return country.is_in_country(points(spark, sf), outlines(spark, sf), ["pid"], "DE", 0).select("pid", "inside")


@query(_OUTLINES + " SELECT pid, coalesce((SELECT id FROM cov WHERE cov.pid = pts.pid AND category = 'orthophoto' AND status = 'active' AND NOT list_contains(tags, 'alternative') AND (strict.country IS NULL OR cov.country IN (strict.country, 'EU')) ORDER BY area_km2, k LIMIT 1), 'l.000005') AS best FROM pts LEFT JOIN strict USING (pid)", "cov")
def best_source_resolved(spark, sf):
    """The country of each point comes from a resolver that the call names."""
    by_outlines = lambda p, by: country.country_at(p, outlines(spark, sf), by, 0)
    p = ranking.with_country(points(spark, sf), ["pid"], by_outlines)
    return ranking.best_source(p, layers(spark, sf), ["pid"], FALLBACK, "resolved")


# Groups and counts


@query("SELECT country, string_agg(id, ',' ORDER BY k) AS ids, count(*) AS n, min(k) AS first_ord FROM lay GROUP BY country", "lay")
def group_by_country(spark, sf):
    return aggregates.group_ids(layers(spark, sf), "country").withColumn("ids", F.array_join("ids", ","))


@query("SELECT category, string_agg(id, ',' ORDER BY k) AS ids, count(*) AS n, min(k) AS first_ord FROM lay GROUP BY category", "lay")
def group_by_category(spark, sf):
    return aggregates.group_ids(layers(spark, sf), "category").withColumn("ids", F.array_join("ids", ","))


@query("""SELECT (SELECT count(*) FROM lay_q) AS layers, (SELECT count(DISTINCT country) FROM lay_q) AS countries, (SELECT count(*) FROM lay_q WHERE queryable) AS queryable, (SELECT max(last_verified) FROM lay_q) AS last_verified,
  (SELECT string_agg(category || '=' || n, ';' ORDER BY category) FROM (SELECT category, count(*)::VARCHAR AS n FROM lay_q GROUP BY category)) AS by_category,
  (SELECT string_agg(type || '=' || n, ';' ORDER BY type) FROM (SELECT type, count(*)::VARCHAR AS n FROM lay_q GROUP BY type)) AS by_service""", "lay")
def catalog_stats(spark, sf):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return aggregates.stats(layers(spark, sf)).select("layers", "countries", "queryable", F.col("lastVerified").alias("last_verified"), shown(F.col("byCategory")).alias("by_category"), shown(F.col("byService")).alias("by_service"))


@query("SELECT country, round(min(w), 6) AS min_lng, round(min(s), 6) AS min_lat, round(max(e), 6) AS max_lng, round(max(n), 6) AS max_lat FROM lay GROUP BY country", "lay")
def bbox_union(spark, sf):
    u = layers(spark, sf).groupBy("country").agg(boxes.union_of("bbox").alias("u"))
    return u.select("country", *[F.round(f"u.{c}", 6).alias(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat")])


@query("SELECT country_here, round(min(lng), 6) AS min_lng, round(min(lat), 6) AS min_lat, round(max(lng), 6) AS max_lng, round(max(lat), 6) AS max_lat FROM pts GROUP BY country_here", "pts")
def bbox_of_points(spark, sf):
    u = points(spark, sf).groupBy("country_here").agg(boxes.around(F.col("lng"), F.col("lat")).alias("u"))
    return u.select("country_here", *[F.round(f"u.{c}", 6).alias(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat")])


@query("SELECT id, round(area_km2, 3) AS area_km2 FROM lay", "lay")
def area_sum(spark, sf):
    return layers(spark, sf).select("id", F.round("area_km2", 3).alias("area_km2"))


@query("""SELECT code, count(*) AS layer_count, count(*) FILTER (own) AS own_count FROM (
  SELECT 'EU' AS code, country = 'EU' AS own FROM lay UNION ALL SELECT country, nuts IS NULL OR nuts = country FROM lay WHERE country <> 'EU'
  UNION ALL SELECT left(nuts, i), i = length(nuts) FROM lay, range(3, 6) r(i) WHERE country <> 'EU' AND nuts IS NOT NULL AND i <= length(nuts)) GROUP BY code""", "lay")
def tree_rollup(spark, sf):
    return aggregates.rollup(layers(spark, sf)).select("code", "layer_count", "own_count")


@query("""SELECT path, code, depth, layer_count FROM (SELECT path, code, depth, count(*) AS layer_count FROM (
  SELECT 'EU' AS path, 'EU' AS code, 0 AS depth FROM lay UNION ALL SELECT 'EU/' || country, country, 1 FROM lay WHERE country <> 'EU'
  UNION ALL SELECT 'EU/' || country || '/' || left(nuts, 3), left(nuts, 3), 2 FROM lay WHERE country <> 'EU' AND nuts IS NOT NULL
  UNION ALL SELECT 'EU/' || country || '/' || left(nuts, 3) || '/' || nuts, nuts, 3 FROM lay WHERE country <> 'EU' AND length(nuts) = 4) GROUP BY ALL)""", "lay")
def region_tree(spark, sf):
    return aggregates.tree(layers(spark, sf)).select("path", "code", "depth", "layer_count")


@query("""SELECT country, string_agg(line, ' | ' ORDER BY first) AS attribution FROM (SELECT country, line, min(k) AS first FROM (
  SELECT k, country, CASE WHEN k % 2 = 0 THEN '<a href="https://provider.example/" target="_blank" rel="noopener">' || attribution || '</a>' ELSE attribution END ||
    CASE WHEN license_id = 'unknown' THEN '' WHEN license_id = 'custom' THEN ' (Open licence)' WHEN k % 6 = 0 THEN ' (<a href="https://terms.example/by" target="_blank" rel="noopener">CC-BY-4.0</a>)' ELSE ' (CC-BY-4.0)' END AS line FROM lay) GROUP BY country, line) GROUP BY country""", "lay")
def attributions(spark, sf):
    return text.credits(layers(spark, sf), ["country"])


# Spherical Mercator, tiles, boxes

_SIN = "sin(radians(lat))"
_TILE = f"greatest(0, least(floor((lng + 180) / 360 * 16384), 16383))::BIGINT AS x, greatest(0, least(floor((0.5 - ln((1 + {_SIN}) / (1 - {_SIN})) / (4 * pi())) * 16384), 16383))::BIGINT AS y"


def _tiles(spark, sf, z: int = 14):
    x, y = mercator.tile_of(F.col("lng"), F.col("lat"), F.lit(z))
    return points(spark, sf).withColumn("z", F.lit(z)).withColumn("x", x).withColumn("y", y)


@query(f"SELECT pid, {_TILE} FROM pts", "pts")
def tile_of_point(spark, sf):
    return _tiles(spark, sf).select("pid", "x", "y")


@query(f"""SELECT pid, round(x * 360 / 16384 - 180 + 1e-9, 6) AS w, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16384)))) + 1e-9, 6) AS s, round((x + 1) * 360 / 16384 - 180 + 1e-9, 6) AS e, round(degrees(atan(sinh(pi() * (1 - 2 * y / 16384)))) + 1e-9, 6) AS n
  FROM (SELECT pid, {_TILE} FROM pts)""", "pts")
def tile_bbox(spark, sf):
    b = mercator.tile_box(F.col("x"), F.col("y"), F.col("z"))
    return _tiles(spark, sf).select("pid", *[F.round(v + 1e-9, 6).alias(c) for c, v in (("w", b.w), ("s", b.s), ("e", b.e), ("n", b.n))])


@query("SELECT pid, round(6378137 * radians(lng), 4) AS mx, round(6378137 * ln(tan(pi()/4 + radians(lat)/2)), 4) AS my, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pts", "pts")
def mercator_roundtrip(spark, sf):
    mx, my = mercator.project(F.col("lng"), F.col("lat"))
    lng, lat = mercator.unproject(mx, my)
    return points(spark, sf).select("pid", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"), F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


@query("""SELECT pid, round(2*pi()*6378137 / (256 * pow(2, pid % 20)), 6) AS flat, round(2*pi()*6378137 / (512 * pow(2, pid % 20)) * cos(radians(lat)), 6) AS here,
  round(log2(2*pi()*6378137 / (256 * (1 + pid % 30) / 10)) + log2(cos(radians(lat))), 6) AS zoom FROM pts""", "pts")
def ground_resolution(spark, sf):
    z = (F.col("pid") % 20).cast("double")
    return points(spark, sf).select("pid", F.round(mercator.meters_per_pixel(z), 6).alias("flat"), F.round(mercator.meters_per_pixel_at(z, F.col("lat"), 512), 6).alias("here"), F.round(mercator.zoom_of_resolution_at((1 + F.col("pid") % 30) / 10, F.col("lat")), 6).alias("zoom"))


@query("""SELECT a.id AS a, b.id AS b, round(greatest(a.w, b.w), 6) AS w, round(greatest(a.s, b.s), 6) AS s, round(least(a.e, b.e), 6) AS e, round(least(a.n, b.n), 6) AS n,
  a.w <= b.w AND a.s <= b.s AND a.e >= b.e AND a.n >= b.n AS contains_b, round(greatest(-180, a.w - 1.5), 6) AS grown_w, round((a.w + a.e) / 2, 6) AS middle, round(a.e - a.w, 6) AS width, round(a.n - a.s, 6) AS height
  FROM lay a JOIN lay b ON a.k < b.k AND a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n""", "lay")
def bbox_algebra(spark, sf):
    rows = layers(spark, sf).select("id", "ord", "bbox")
    a, b = Box.of("p.bbox"), Box.of("q.bbox")
    met = spatial.box_pairs(rows).join(rows.alias("p"), F.col("ord_a") == F.col("p.ord")).join(rows.alias("q"), F.col("ord_b") == F.col("q.ord"))
    i = Box.of("i")
    return met.withColumn("i", a.intersection(b)).select(
        F.col("p.id").alias("a"), F.col("q.id").alias("b"), *[F.round(v, 6).alias(c) for c, v in (("w", i.w), ("s", i.s), ("e", i.e), ("n", i.n))], a.contains_box(b).alias("contains_b"), F.round(a.grown(1.5).w, 6).alias("grown_w"),
        F.round(a.center()[0], 6).alias("middle"), F.round(a.width(), 6).alias("width"), F.round(a.height(), 6).alias("height"),
    )


@query("""SELECT pid, round(w, 3) AS w, round(e, 3) AS e, CASE WHEN w <= e THEN lng BETWEEN w AND e ELSE lng >= w OR lng <= e END AS inside, round(CASE WHEN w <= e THEN e - w ELSE 360 - w + e END, 6) AS width, (w <= e OR w > 0) AND w >= -180 AND e <= 180 AS valid
  FROM (SELECT pid, lng, pid*53 % 360 - 180 AS w, pid*97 % 360 - 180 AS e FROM pts)""", "pts")
def antimeridian(spark, sf):
    w, e = (F.col("pid") * 53 % 360 - 180).cast("double"), (F.col("pid") * 97 % 360 - 180).cast("double")
    b = Box(w, F.lit(-90.0), e, F.lit(90.0))
    return points(spark, sf).select("pid", F.round(w, 3).alias("w"), F.round(e, 3).alias("e"), b.contains(F.col("lng"), F.lit(0.0)).alias("inside"), F.round(b.width(), 6).alias("width"), boxes.is_valid(b.array()).alias("valid"))


@query("SELECT id, round(greatest(w, 0), 6) AS w, round(greatest(s, 40), 6) AS s, round(least(e, 20), 6) AS e, round(least(n, 60), 6) AS n FROM lay", "lay")
def bbox_clamp(spark, sf):
    b = Box.of("bbox").clamped(Box.at((0.0, 40.0, 20.0, 60.0)))
    return layers(spark, sf).select("id", *[F.round(v, 6).alias(c) for c, v in (("w", b.w), ("s", b.s), ("e", b.e), ("n", b.n))])


@query("SELECT id, round(6378137 * radians(w), 3) AS w, round(6378137 * ln(tan(pi()/4 + radians(s)/2)), 3) AS s, round(6378137 * radians(e), 3) AS e, round(6378137 * ln(tan(pi()/4 + radians(n)/2)), 3) AS n FROM lay", "lay")
def bbox_mercator(spark, sf):
    b = mercator.project_box(Box.of("bbox"))
    return layers(spark, sf).select("id", *[F.round(v, 3).alias(c) for c, v in (("w", b.w), ("s", b.s), ("e", b.e), ("n", b.n))])


@query("SELECT id, 16 BETWEEN min_zoom AND max_zoom AS visible, 'mapweave-' || id AS source_id, 'mapweave-' || id || '-raster' AS layer_id, 'mapweave://' || id || '/{z}/{x}/{y}' AS template FROM lay", "lay")
def layer_names(spark, sf):
    return layers(spark, sf).select("id", is_visible_at(F.lit(16)).alias("visible"), adapters.source_id().alias("source_id"), adapters.layer_id().alias("layer_id"), adapters.own_template().alias("template"))


# Sources of tiles

_ORDERED = """, cand AS (SELECT *, row_number() OVER (ORDER BY area_km2, k) AS mosaic_ord FROM lay WHERE category IN ('orthophoto', 'satellite') AND type <> 'WFS' AND status = 'active' AND NOT list_contains(tags, 'alternative')),
tiles AS (SELECT DISTINCT x, y FROM (SELECT %s FROM pts)),
mid AS (SELECT x, y, (x * 360 / 16384 - 180 + (x + 1) * 360 / 16384 - 180) / 2 AS lng, (degrees(atan(sinh(pi() * (1 - 2 * y / 16384)))) + degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16384))))) / 2 AS lat FROM tiles),
met AS (SELECT DISTINCT x, y, c.* FROM mid t JOIN ext b ON t.lng BETWEEN b.w AND b.e AND t.lat BETWEEN b.s AND b.n JOIN cand c ON c.k = b.k WHERE id <> 'l.000005' AND min_zoom <= 15),
named AS (SELECT *, first_value(country IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY CASE WHEN country = 'EU' THEN 1 ELSE 0 END, mosaic_ord) AS guess FROM met),
chain AS (SELECT x, y, id, CASE WHEN guess <> 'EU' AND country <> guess AND country <> 'EU' THEN 1 ELSE 0 END AS part, mosaic_ord FROM named UNION ALL SELECT x, y, 'l.000005', 2, 0 FROM tiles),
chosen AS (SELECT 14 AS z, x, y, row_number() OVER (PARTITION BY x, y ORDER BY part, mosaic_ord) AS nth, id, count(*) OVER (PARTITION BY x, y) <= 1 AS satellite_only FROM chain) """ % _TILE


def _candidates(spark, sf):
    """The order by area alone, which SQL can give; mosaic_ranked has the comparator's. Only what is counted and drawn goes through the one task that counts."""
    drawn = filters.imagery_candidates(layers(spark, sf)).select("id", "ord", "area_km2", "extents", "minZoom", "country")
    return drawn.withColumn("mosaic_ord", F.row_number().over(Window.orderBy("area_km2", "ord")))


@query(_ORDERED + "SELECT * FROM chosen", "pts", "lay")
def tile_select(spark, sf):
    return mosaic.select(_tiles(spark, sf).select("z", "x", "y").distinct(), _candidates(spark, sf), FALLBACK)


@query(_ORDERED + "SELECT z, x, y, id FROM chosen WHERE nth = 1", "pts", "lay")
def tile_best(spark, sf):
    return mosaic.best_for(_tiles(spark, sf).select("z", "x", "y").distinct(), _candidates(spark, sf), FALLBACK)


@query("SELECT DISTINCT 9 AS z, x // 32 AS x, y // 32 AS y, 1 AS nth, 'l.000005' AS id, true AS satellite_only FROM (SELECT %s FROM pts)" % _TILE, "pts")
def tile_select_low_zoom(spark, sf):
    return mosaic.select(_tiles(spark, sf, 9).select("z", "x", "y").distinct(), _candidates(spark, sf), FALLBACK)


@query()
def mosaic_ranked(spark, sf):
    """The comparator of areas with tolerance, made on the driver; SQL has no such order."""
    return ranking.mosaic_order(layers(spark, sf)).select("id", "mosaic_ord")


_DEEP = 2**21


@query(f""", deep AS (SELECT pid, lat AS plat, floor((lng + 180) / 360 * {_DEEP}) AS x, floor((0.5 - ln((1 + {_SIN}) / (1 - {_SIN})) / (4 * pi())) * {_DEEP}) AS y FROM pts),
mid AS (SELECT pid, plat, (x + 0.5) * 360 / {_DEEP} - 180 AS lng, (degrees(atan(sinh(pi() * (1 - 2 * y / {_DEEP})))) + degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / {_DEEP}))))) / 2 AS lat FROM deep),
near AS (SELECT pid, arg_min(l.k, struct_pack(a := area_km2, k := l.k)) AS k FROM mid m JOIN ext b ON m.lng BETWEEN b.w AND b.e AND m.lat BETWEEN b.s AND b.n JOIN lay l ON l.k = b.k
  WHERE category IN ('orthophoto', 'satellite') AND type <> 'WFS' AND status = 'active' AND NOT list_contains(tags, 'alternative') AND id <> 'l.000005' GROUP BY pid),
best AS (SELECT m.pid, plat, coalesce(near.k, 5) AS k FROM mid m LEFT JOIN near ON near.pid = m.pid)
SELECT pid, round(least(22, max_zoom, greatest(12, log2(2*pi()*6378137 / (256 * resolution)) + log2(cos(radians(plat))) + 1)), 6) AS detail_zoom FROM best JOIN lay USING (k)""", "pts", "lay")
def detail_zoom(spark, sf):
    rows = mosaic.detail_zoom(points(spark, sf), _single_country(_candidates(spark, sf)), layers(spark, sf), FALLBACK, ["pid"])
    return rows.select("pid", F.round("detail_zoom", 6).alias("detail_zoom"))


def _single_country(candidates):
    return candidates.withColumn("country", F.lit("EU"))


@query("SELECT pid, '14/' || (x >> 2) || '/' || (y >> 2) AS block, (x >> 2) || '/' || (y >> 2) AS area, (x << 2) || '/' || (y << 2) AS finer FROM (SELECT pid, %s FROM pts)" % _TILE, "pts")
def block_keys(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return _tiles(spark, sf).select("pid", mercator.block_key(x, y, z).alias("block"), mercator.area_key(x, y, z).alias("area"), mercator.area_key(x, y, F.lit(10)).alias("finer"))


_FEW = "few AS (SELECT pid, 5 AS z, pid % 32 AS x, pid // 32 % 32 AS y FROM pts)"


def _few(spark, sf):
    return points(spark, sf).select("pid", F.lit(5).alias("z"), (F.col("pid") % 32).alias("x"), (F.floor(F.col("pid") / 32) % 32).alias("y"))


@query(f", {_FEW} SELECT pid, (x + dx + 32) % 32 AS px, y + dy AS py FROM few, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE (dx <> 0 OR dy <> 0) AND y + dy BETWEEN 0 AND 31", "pts")
def prefetch_ring(spark, sf):
    return mosaic.prefetch_around(_few(spark, sf)).select("pid", "px", "py")


@query(f""", {_FEW}, m AS (SELECT *, CASE pid % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS sx, CASE pid % 4 WHEN 1 THEN 1.0 ELSE 0.0 END AS sy FROM few),
ahead AS (SELECT DISTINCT pid, floor(floor(x + sx*step + 0.5) - sy*across + 0.5) AS tx, floor(floor(y + sy*step + 0.5) + sx*across + 0.5) AS ty FROM m, range(1, 3) a(step), range(-1, 2) b(across) WHERE pid % 4 <> 3)
SELECT pid, ((tx + 32) % 32)::BIGINT AS px, ty::BIGINT AS py FROM ahead WHERE ty BETWEEN 0 AND 31 UNION ALL SELECT pid, (x + dx + 32) % 32, y + dy FROM few, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE pid % 4 = 3 AND (dx <> 0 OR dy <> 0) AND y + dy BETWEEN 0 AND 31""", "pts")
def prefetch_ahead(spark, sf):
    p = F.col("pid") % 4
    moves = _few(spark, sf).withColumn("heading_x", F.when(p == 0, 2.0).when(p == 2, -3.0).otherwise(0.0)).withColumn("heading_y", F.when(p == 1, 5.0).otherwise(0.0))
    return mosaic.prefetch_ahead(moves).select("pid", "px", "py")


@query(f", {_FEW} SELECT pid, q AS quadrant, x*2 + q % 2 AS cx, y*2 + q // 2 AS cy, 6 AS cz FROM few, range(4) r(q)", "pts")
def stitch_children(spark, sf):
    return mosaic.child_tiles(_few(spark, sf)).select("pid", F.col("quadrant").cast("long").alias("quadrant"), "cx", "cy", "cz")


@query(""", used AS (SELECT layer_id, max(ts) AS used_at FROM log WHERE outcome = 'served' GROUP BY layer_id HAVING max(ts) >= (SELECT max(ts) FROM log) - INTERVAL 7200 SECOND),
lines AS (SELECT attribution || CASE WHEN license_id = 'unknown' THEN '' WHEN license_id = 'custom' THEN ' (Open licence)' ELSE ' (CC-BY-4.0)' END AS line, max(used_at) AS latest, min(k) AS k FROM lay JOIN used ON layer_id = id GROUP BY 1)
SELECT string_agg(line, ' | ' ORDER BY latest DESC) AS attribution FROM lines""", "lay", "log")
def active_attribution(spark, sf):
    log = tile_log(spark, sf)
    active = state.active_sources(log, F.col("outcome") == "served", F.lit(log.agg(F.max("ts")).first()[0]), 7200)
    return mosaic.active_attribution(active, layers(spark, sf), FALLBACK, html=False)


@query()
def place_walk(spark, sf):
    """Two places at three zooms, with the sources in the comparator's order."""
    places = spark.createDataFrame([("north", 11.0, 60.0), ("south", 11.0, 43.0)], "name string, lng double, lat double")
    return mosaic.walk(places, [8, 14, 18], ranking.mosaic_order(layers(spark, sf)), FALLBACK).select("name", "z", "nth", "id")


# Coordinate systems

# Spellings and what they mean: authority, identifier, canonical code, latitude first.
SPELLINGS = [
    ("EPSG:4326", "EPSG", "4326", "EPSG:4326", True), ("urn:ogc:def:crs:EPSG::4326", "EPSG", "4326", "EPSG:4326", True), ("urn:x-ogc:def:crs:EPSG:6.9:3035", "EPSG", "3035", "EPSG:3035", True),
    ("http://www.opengis.net/def/crs/EPSG/0/25832", "EPSG", "25832", "EPSG:25832", False), ("http://www.opengis.net/gml/srs/epsg.xml#4258", "EPSG", "4258", "EPSG:4258", True), ("epsg::900913", "EPSG", "900913", "EPSG:3857", False),
    ("102100", "EPSG", "102100", "EPSG:3857", False), ("EPSG3857", "EPSG", "3857", "EPSG:3857", False), ("CRS84", None, None, "CRS:84", False), ("OGC:CRS84", "OGC", "CRS84", "CRS:84", False),
    ("urn:ogc:def:crs:OGC:1.3:CRS84", "OGC", "CRS84", "CRS:84", False), ("IGNF:LAMB93", "IGNF", "LAMB93", "IGNF:LAMB93", False), (" wgs  84 ", None, None, "EPSG:4326", True), ("junk", None, None, "JUNK", False), ("EPSG:6706", "EPSG", "6706", "EPSG:6706", True),
]


def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'"


def _spellings(spark):
    return spark.createDataFrame([(i, s[0]) for i, s in enumerate(SPELLINGS)], "i long, name string")


_CANON = ", ".join(f"({i}, '{s[0]}', '{s[3]}', {str(s[4]).lower()})" for i, s in enumerate(SPELLINGS))


@query(f"SELECT i::BIGINT AS i, name, code, first FROM (VALUES {_CANON}) t(i, name, code, first)")
def crs_normalize(spark, sf):
    return _spellings(spark).select("i", "name", REGISTRY.normalise(F.col("name")).alias("code"), REGISTRY.latitude_first(F.col("name")).alias("first"))


@query("SELECT i::BIGINT AS i, authority, identifier FROM (VALUES " + ", ".join(f"({i}, {_text(s[1])}, {_text(s[2])})" for i, s in enumerate(SPELLINGS)) + ") t(i, authority, identifier)")
def crs_parse(spark, sf):
    return _spellings(spark).select("i", REGISTRY.parse(F.col("name")).alias("p")).select("i", "p.authority", "p.identifier")


@query(f"""WITH t(i, name, code, first) AS (VALUES {_CANON}) SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, a.code = b.code OR (a.code IN ('EPSG:4326', 'CRS:84') AND b.code IN ('EPSG:4326', 'CRS:84')) AS same FROM t a, t b WHERE a.i < b.i""")
def crs_same(spark, sf):
    a, b = _spellings(spark).alias("a"), _spellings(spark).alias("b")
    return a.join(b, F.col("a.i") < F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), REGISTRY.same(F.col("a.name"), F.col("b.name")).alias("same"))


@query("""SELECT id, v AS version, c AS crs, CASE WHEN v = '1.3.0' AND c = 'EPSG:4326' THEN 'latlon' ELSE 'lonlat' END AS axis, CASE WHEN v = '1.3.0' AND c = 'EPSG:4326' THEN printf('%.2f,%.2f,%.2f,%.2f', s, w, n, e) ELSE printf('%.2f,%.2f,%.2f,%.2f', w, s, e, n) END AS box
  FROM lay, (VALUES ('1.1.1'), ('1.3.0')) a(v), (VALUES ('EPSG:4326'), ('CRS:84'), ('EPSG:3857')) b(c)""", "lay")
def bbox_format(spark, sf):
    rows = layers(spark, sf).select("id", "bbox", F.explode(F.array(F.lit("1.1.1"), F.lit("1.3.0"))).alias("version")).select("*", F.explode(F.array(F.lit("EPSG:4326"), F.lit("CRS:84"), F.lit("EPSG:3857"))).alias("crs"))
    return rows.select("id", "version", "crs", REGISTRY.axis_order(F.col("crs"), F.col("version")).alias("axis"), urls.format_box(Box.of("bbox"), F.col("crs"), F.col("version"), 2).alias("box"))


@query("SELECT id, round(w, 2) AS w, round(s, 2) AS s, round(e, 2) AS e, round(n, 2) AS n FROM lay", "lay")
def bbox_parse(spark, sf):
    """Written latitude first and read back."""
    crs, version = F.lit("EPSG:4326"), F.lit("1.3.0")
    rows = layers(spark, sf).withColumn("b", urls.parse_box(urls.format_box(Box.of("bbox"), crs, version), crs, version))
    b = Box.of("b")
    return rows.select("id", *[F.round(v, 2).alias(c) for c, v in (("w", b.w), ("s", b.s), ("e", b.e), ("n", b.n))])


@query("SELECT id, to_json({'type': 'Polygon', 'coordinates': [[[w, s], [e, s], [e, n], [w, n], [w, s]]]})::VARCHAR AS geojson FROM lay", "lay")
def bbox_polygon(spark, sf):
    return layers(spark, sf).select("id", Box.of("bbox").polygon().alias("geojson"))


# Regions and countries


@query("SELECT id, coalesce(nuts, nuts0) AS code, greatest(0, least(3, length(coalesce(nuts, nuts0)) - 2)) AS level, CASE WHEN length(nuts) > 2 THEN left(nuts, length(nuts) - 1) END AS parent, left(coalesce(nuts, nuts0), 2) AS country_code FROM lay", "lay")
def nuts_level(spark, sf):
    code = F.coalesce("nuts", nuts.of_country(F.col("country")))
    return layers(spark, sf).select("id", code.alias("code"), nuts.level(code).alias("level"), nuts.parent(code).alias("parent"), nuts.country(code).alias("country_code"))


@query("SELECT id, (length(nuts) - i)::INT AS nth, left(nuts, i) AS ancestor FROM lay, range(2, 4) r(i) WHERE i < length(nuts)", "lay")
def nuts_ancestors(spark, sf):
    rows = layers(spark, sf).filter("nuts IS NOT NULL").select("id", F.posexplode(nuts.ancestors(F.col("nuts"))).alias("nth", "ancestor"))
    return rows.select("id", F.col("nth") + 1, "ancestor").toDF("id", "nth", "ancestor")


@query("SELECT a.id AS child, b.code AS ancestor FROM lay a JOIN (SELECT DISTINCT left(nuts, 3) AS code FROM lay WHERE nuts IS NOT NULL) b ON starts_with(a.nuts, b.code)", "lay")
def nuts_within(spark, sf):
    rows = layers(spark, sf).filter("nuts IS NOT NULL").select("id", "nuts")
    above = rows.select(F.substring("nuts", 1, 3).alias("ancestor")).distinct()
    return rows.join(above, nuts.within(F.col("nuts"), F.col("ancestor"))).select(F.col("id").alias("child"), "ancestor")


@query(f"SELECT n_nationkey AS nk, iso, coalesce(c.nuts, CASE WHEN iso = 'EU' THEN 'EU' END) AS nuts, iso IN ('EU', {', '.join(repr(n) for n, _, _ in nuts.COUNTRIES)}) AS is_nuts FROM nation JOIN codes ON n_nationkey = nk LEFT JOIN (VALUES {_ISO_OF}) c(nuts, i) ON c.i = iso", "codes")
def iso_nuts(spark, sf):
    rows = outlines(spark, sf).filter("ring = 0").select(F.col("shape").cast("int").alias("nk"), "iso")
    return rows.select("nk", "iso", nuts.of_country(F.col("iso")).alias("nuts"), nuts.is_nuts_country(F.col("iso")).alias("is_nuts"))


@query("SELECT id, country, nuts, nuts IS NOT NULL AS valid FROM lay", "lay")
def nuts_valid(spark, sf):
    iso = nuts.iso_countries(spark)
    return layers(spark, sf).filter(nuts.is_country(F.col("country"), iso)).select("id", "country", "nuts", nuts.is_valid(F.col("nuts")).alias("valid"))


# Texts and URLs


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type"), ascii_only=True).alias("slug"))


@query()
def slugify_marks(spark, sf):
    """Accents off, in every language; SQL has no canonical decomposition."""
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.layer_id(F.col("lang"), F.col("source")).alias("layer_id"))


@query("""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages""")
def entity_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


_URL = "'https://maps.example/' || replace(lower(s_name), '#', '-')"
_JOIN = "CASE WHEN k % 3 = 0 THEN '?' WHEN k % 3 = 1 THEN '?map=x y&' ELSE '?' END"


@query(f"SELECT id, {_URL} || {_JOIN} || 'Q=' || replace(title, ' ', '%20') || '&CRS=EPSG:3857&LIST=a,b&MORE=' || k AS url FROM lay WHERE title ~ '^[A-Za-z0-9 _.-]*$'", "lay")
def query_url(spark, sf):
    params = [("Q", F.col("title")), ("CRS", F.lit("EPSG:3857")), ("NONE", F.lit(None)), ("LIST", F.lit("a,b"))]
    rows = layers(spark, sf).filter(F.col("title").rlike("^[A-Za-z0-9 _.-]*$"))
    return rows.select("id", urls.with_query(F.col("service.url"), params, F.create_map(F.lit("MORE"), F.col("ord").cast("string"))).alias("url"))


@query(f"""SELECT id, {_URL} || {_JOIN} || 'SERVICE=WMS&VERSION=' || v || '&REQUEST=GetMap&LAYERS=layer_' || k || '&STYLES=&FORMAT=image%2Fpng&TRANSPARENT=TRUE&WIDTH=256&HEIGHT=256&SRS=' || c || '&CRS=' || c || '&BBOX={{bbox-epsg-3857}}' AS url
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN '1.3.0' ELSE '1.1.1' END AS v, 'EPSG:3857' AS c FROM lay WHERE type = 'WMS')""", "lay")
def getmap_url(spark, sf):
    return layers(spark, sf).filter("service.type = 'WMS'").select("id", urls.wms_template(F.col("service.url"), F.col("service.wms")).alias("url"))


@query(f"""SELECT id, {_URL} || {_JOIN} || 'SERVICE=WMTS&VERSION=1.0.0&REQUEST=GetTile&LAYER=layer_' || k || '&STYLE=default&FORMAT=image%2Fjpeg&TILEMATRIXSET=grid&TILEMATRIX=7&TILEROW=42&TILECOL=65' AS url FROM lay WHERE type = 'WMTS'
  UNION ALL SELECT id, 'https://' || substr('abc', (107 % 3 + 1)::INT, 1) || '.tiles.example/layer_' || k || '/7/65/' || CASE WHEN k % 2 = 0 THEN 85 ELSE 42 END || '.png' FROM lay WHERE type = 'XYZ'""", "lay")
def tile_url(spark, sf):
    at = (F.lit(65).cast("long"), F.lit(42).cast("long"), F.lit(7))
    return layers(spark, sf).filter("service.type IN ('WMTS', 'XYZ')").select("id", urls.tile_url(F.col("service"), *at).alias("url"))


@query("SELECT id, string_agg('https://' || d || '.tiles.example/layer_' || k || '/{z}/{x}/{y}.png', ' ' ORDER BY d) AS templates FROM lay, (VALUES ('a'), ('b'), ('c')) s(d) WHERE type = 'XYZ' GROUP BY id", "lay")
def xyz_url(spark, sf):
    return layers(spark, sf).filter("service.type = 'XYZ'").select("id", F.array_join(urls.xyz_templates(F.col("service.xyz")), " ").alias("templates"))


@query(f"SELECT id, {_URL} || CASE WHEN k % 3 = 1 THEN '?map=x y&' ELSE '?' END || 'SERVICE=WMS&REQUEST=GetCapabilities&VERSION=1.3.0' AS url FROM lay", "lay")
def capabilities_url(spark, sf):
    return layers(spark, sf).select("id", urls.capabilities_url(F.concat("service.url", F.when(F.col("service.url").endswith("?"), "Version=9").when(F.contains("service.url", F.lit("?")), "&Version=9").otherwise("?Version=9"))).alias("url"))


@query(f"SELECT id, {_URL} || {_JOIN} || 'SERVICE=WFS&VERSION=2.0.0&REQUEST=GetFeature&TYPENAMES=layer_' || k || '&OUTPUTFORMAT=application%2Fjson&SRSNAME=EPSG:4326&COUNT=10&PROPERTYNAME=a,b&SORTBY=a' AS url FROM lay WHERE type = 'WFS'", "lay")
def feature_url(spark, sf):
    return layers(spark, sf).filter("service.type = 'WFS'").select("id", urls.get_feature_url(F.col("service.url"), F.col("service.wfs"), count=10, properties=["a", "b"], sort="a").alias("url"))


@query()
def map_requests(spark, sf):
    """GetMap, legend and feature-information requests of every WMS layer at the middle of its box; floating-point text is compared in the tests."""
    rows = layers(spark, sf).filter("service.type = 'WMS'")
    lng, lat = Box.of("bbox").center()
    x, y = mercator.tile_of(lng, lat, F.lit(10))
    s = F.col("service")
    return rows.select("id", urls.tile_url(s, x, y, F.lit(10)).alias("map"), urls.legend_url(s["url"], s["wms"]).alias("legend"), urls.feature_info_url(s["url"], s["wms"], lng, lat).alias("info"))


@query("""SELECT pid, least(greatest(floor((lng + 30.00037) / 80 * 800 + 0.5), 0), 799)::INT AS i FROM pts""", "pts")
def click_pixel(spark, sf):
    w = urls.click_window(F.col("lng"), F.col("lat"), Box.at((-30.00037, 30.0, 49.99963, 75.0)), 800, 600)
    return points(spark, sf).select("pid", w["i"].alias("i"))


# Adapters


@query()
def style_document(spark, sf):
    return adapters.style(layers(spark, sf), "Europe")


@query()
def map_bindings(spark, sf):
    return adapters.binding(layers(spark, sf))


@query("SELECT id, CASE WHEN type = 'WMS' AND k % 5 = 0 THEN 'tileLayer.custom' WHEN type = 'WMS' THEN 'tileLayer.wms' ELSE 'tileLayer' END AS leaflet, CASE type WHEN 'WMS' THEN 'TileWMS' ELSE type END AS openlayers FROM lay WHERE type <> 'WFS'", "lay")
def adapter_kinds(spark, sf):
    rows = layers(spark, sf).select("id", adapters.leaflet_source().alias("l"), adapters.openlayers_source().alias("o"))
    return rows.filter("l IS NOT NULL").select("id", F.col("l.kind").alias("leaflet"), F.col("o.kind").alias("openlayers"))


@query("SELECT round(z / 10, 1) AS zoom, round(CASE WHEN z <= 135 THEN 0 WHEN z >= 155 THEN 0.8 ELSE (z / 10 - 13.5) / 2 * 0.8 END, 9) AS opacity FROM range(0, 220) r(z)")
def fade_opacity(spark, sf):
    zoom = F.round(F.col("id") / 10, 1)
    return spark.range(220).select(zoom.alias("zoom"), F.round(adapters.mosaic_opacity(zoom, 13.5, 15.5, 0.8), 9).alias("opacity"))


@query("SELECT DISTINCT 'maps.example' AS host FROM supplier")
def proxy_hosts(spark, sf):
    return adapters.host_allow_list(layers(spark, sf))


# Collections: checks and registration


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}')" for s, p in samples.EXPECTED_ISSUES) + ") t(source, path)")
def validate_issues(spark, sf):
    return collections.build(collections.documents(spark, samples.COLLECTIONS))[1].select("source", "path")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', {z})" for i, t, z in samples.EXPECTED_LAYERS) + ") t(id, type, maxZoom)")
def build_catalog(spark, sf):
    return collections.build(collections.documents(spark, samples.COLLECTIONS))[0].select("id", "service.type", "maxZoom")


@query("SELECT id FROM lay UNION ALL SELECT 'xx.runtime.one'", "lay")
def register_collection(spark, sf):
    base = layers(spark, sf).withColumn("id", F.col("id"))
    return collections.register(base, collections.documents(spark, samples.RUNTIME))[0].select("id")


# Documents


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{name}', {q}, '{crs}')" for n, name, q, crs in samples.EXPECTED_WMS) + ") t(node, name, queryable, crs)")
def wms_layers(spark, sf):
    rows = capabilities.parse_wms(spark.createDataFrame([("a", samples.WMS_130)], "doc_id string, xml string")).filter("name IS NOT NULL")
    return rows.select("node", "name", "queryable", F.array_join("crs", " ").alias("crs"))


@query()
def wms_errors(spark, sf):
    return capabilities.parse_wms(spark.createDataFrame(samples.BROKEN, "doc_id string, xml string")).select("doc_id", "error_code")


@query()
def wms_catalogue(spark, sf):
    rows = capabilities.parse_wms(spark.createDataFrame([("a", samples.WMS_130, "https://maps.example/wms"), ("b", samples.WMS_111, "https://old.example/wms")], "doc_id string, xml string, url string"))
    return capabilities.wms_to_layers(rows, "cadastre", {"name": "Survey"}, {"id": "CC-BY-4.0"}, "IT").select("id", "title", "service.type", F.to_json("bbox").alias("bbox"), F.to_json("service.wms").alias("options"))


@query("SELECT 'ortho' AS identifier, 'web' AS matrix_set, 'EPSG:3857' AS crs, 'REST' AS encoding")
def wmts_layers(spark, sf):
    rows = capabilities.parse_wmts(spark.createDataFrame([("a", samples.WMTS)], "doc_id string, xml string"))
    made = capabilities.wmts_to_layers(rows, "satellite", {"name": "Survey"}, {"id": "CC-BY-4.0"}, "EU")
    return made.select("service.wmts.layer", "service.wmts.tileMatrixSet", "service.wmts.crs", "service.wmts.requestEncoding").toDF("identifier", "matrix_set", "crs", "encoding")


@query("""WITH own AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS v13, 'R' || s_suppkey AS root, 'EPSG:' || (20000 + s_suppkey % 900) AS extra, s_suppkey % 70 - 30 AS w, s_suppkey % 40 + 10 AS s FROM supplier)
  SELECT 'd' || k AS doc_id, name, depth, flag AS queryable, crs, w, s, w + 5 AS e, s + 4 AS n, max_scale FROM (
  SELECT k, 'a' || k AS name, 1 AS depth, true AS flag, 'CRS:84 ' || extra || ' EPSG:3857' AS crs, w, s, (1000 * (1 + k % 9))::DOUBLE AS max_scale FROM own
  UNION ALL SELECT k, 'b' || k, 1, k % 3 = 0, 'CRS:84 ' || extra, w + 1, s, NULL FROM own
  UNION ALL SELECT k, 'c' || k, 2, k % 3 = 0, 'CRS:84 ' || extra, w + 1, s, NULL FROM own)""")
def wms_inheritance(spark, sf):
    """A capabilities document a supplier: systems add up from the root, flags and boxes are taken from above unless stated."""
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    w, south = k % 70 - 30, k % 40 + 10

    def box(w):
        return text("<EX_GeographicBoundingBox><westBoundLongitude>", w, "</westBoundLongitude><eastBoundLongitude>", w + 5, "</eastBoundLongitude><southBoundLatitude>", south, "</southBoundLatitude><northBoundLatitude>", south + 4, "</northBoundLatitude></EX_GeographicBoundingBox>")

    flag = lambda c: F.when(c, "1").otherwise("0")
    xml = text(
        '<WMS_Capabilities version="1.3.0" xmlns="http://www.opengis.net/wms"><Service><Title>S</Title></Service><Capability><Layer queryable="', flag(k % 3 == 0), '"><Title>R', k, "</Title><CRS>CRS:84</CRS><CRS>EPSG:", 20000 + k % 900, "</CRS>", box(w),
        '<Layer queryable="1"><Name>a', k, "</Name><CRS>EPSG:3857</CRS><MaxScaleDenominator>", (1 + k % 9) * 1000, "</MaxScaleDenominator></Layer>",
        "<Layer><Name>b", k, "</Name>", box(w + 1), "<Layer><Name>c", k, "</Name></Layer></Layer></Layer></Capability></WMS_Capabilities>",
    )
    found = capabilities.parse_wms(table(spark, sf, "supplier").select(text("d", k).alias("doc_id"), xml.alias("xml"))).filter("name IS NOT NULL")
    b = [F.col(f"bbox.{c}").cast("int").alias(n) for c, n in (("min_lng", "w"), ("min_lat", "s"), ("max_lng", "e"), ("max_lat", "n"))]
    return found.select("doc_id", "name", "depth", "queryable", F.array_join("crs", " ").alias("crs"), *b, "max_scale")


@query("SELECT event_id, 'html' AS format, i::INT AS nth, event_type || ' & co' AS kind, (user_id + i)::VARCHAR AS owner FROM events, range(2) r(i)")
def featureinfo_html(spark, sf):
    """A table with a header row and two features for each event."""
    row = lambda i: F.concat(F.lit("<tr class=x><td> "), "event_type", F.lit(" &amp; <b>co</b></td><td>"), (F.col("user_id") + i).cast("string"), F.lit("</td></tr>"))
    body = F.concat(F.lit("<html><p>Found</p><table border=1><tr><th>kind</th><TH>owner</TH></tr>"), row(0), F.lit("\n"), row(1), F.lit("</table></html>"))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"), F.lit("text/html").alias("content_type"))
    parsed = featureinfo.parse(rows).select("event_id", "format", F.posexplode("features").alias("nth", "f"))
    return parsed.select("event_id", "format", "nth", F.element_at("f.properties", "kind").alias("kind"), F.element_at("f.properties", "owner").alias("owner"))


@query("SELECT event_id, 'gml' AS format, 'lot' AS layer, event_id::VARCHAR AS id, event_type AS kind, user_id::VARCHAR AS owner FROM events")
def featureinfo_gml(spark, sf):
    body = F.concat(F.lit('<wfs:FeatureCollection xmlns:wfs="w" xmlns:gml="g"><gml:featureMember><lot fid="'), F.col("event_id").cast("string"), F.lit('"><kind>'), "event_type", F.lit("</kind><owner>"), F.col("user_id").cast("string"), F.lit("</owner><geom><gml:Point>1 2</gml:Point></geom></lot></gml:featureMember></wfs:FeatureCollection>"))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"), F.lit("application/vnd.ogc.gml").alias("content_type"))
    parsed = featureinfo.parse(rows).select("event_id", "format", F.explode("features").alias("f"))
    return parsed.select("event_id", "format", "f.layer", "f.id", F.element_at("f.properties", "kind").alias("kind"), F.element_at("f.properties", "owner").alias("owner"))


@query("SELECT event_id, 'json' AS format, len(json_keys(props)) AS n FROM events WHERE props IS NOT NULL")
def featureinfo_json(spark, sf):
    rows = table(spark, sf, "events").filter("props IS NOT NULL").select("event_id", F.col("props").alias("body"), F.lit("application/json").alias("content_type"))
    return featureinfo.parse(rows).select("event_id", "format", F.size(F.get("features", F.lit(0))["properties"]).cast("long").alias("n"))


@query("SELECT e.event_id, 'text' AS format, 'lot' AS layer, i::INT AS nth, CASE WHEN i = 0 THEN event_type ELSE (user_id)::VARCHAR END AS value FROM events e, range(2) r(i)")
def featureinfo_text(spark, sf):
    body = F.concat(F.lit("Results for FeatureType 'lot':\n-----\n kind = "), "event_type", F.lit("\n-----\nkind="), F.col("user_id").cast("string"), F.lit("\n"))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"), F.lit("text/plain").alias("content_type"))
    parsed = featureinfo.parse(rows).select("event_id", "format", F.posexplode("features").alias("nth", "f"))
    return parsed.select("event_id", "format", "f.layer", "nth", F.element_at("f.properties", "kind").alias("value"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{f}', {n})" for d, f, n in samples.EXPECTED_ANSWERS) + ") t(doc_id, format, n)")
def featureinfo_formats(spark, sf):
    """One answer of each kind: JSON, GML, three shapes of tables, text, blank, broken, an exception."""
    rows = spark.createDataFrame(samples.ANSWERS, "doc_id string, body string, content_type string")
    return featureinfo.parse(rows).select("doc_id", "format", F.size("features").alias("n"))


@query("SELECT nk::BIGINT AS shape, iso, 9::INT AS n FROM nation JOIN codes ON n_nationkey = nk", "codes")
def outline_ingest(spark, sf):
    """GeoJSON to rings on the grid: repeated points go."""
    rings = outlines(spark, sf).filter("ring = 0")
    pairs = F.transform("points", lambda p: F.array(p["lng"], p["lat"]))
    closed = F.concat(F.array(F.get(pairs, F.lit(0))), pairs, F.array(F.get(pairs, F.lit(0))))
    features = rings.select(F.struct("iso", "shape").alias("iso"), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))).alias("geometry"))
    return outline_source.from_geojson(features).select("iso.shape", "iso.iso", F.size("points").alias("n"))


# What serving learns


@query("SELECT seq, layer_id, coalesce(ts <= max(CASE WHEN outcome = 'failed' THEN ts END) OVER (PARTITION BY layer_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 3600 SECOND, false) AS is_failing FROM log", "log")
def failure_backoff(spark, sf):
    return state.failing(tile_log(spark, sf), F.col("outcome") == "failed", 3600).select("seq", "layer_id", "is_failing")


@query("SELECT seq, z || '/' || (x >> 2) || '/' || (y >> 2) AS block, coalesce(max(outcome = 'blank') OVER (PARTITION BY layer_id, z, x >> 2, y >> 2 ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_blank_here FROM log", "log")
def blank_memory(spark, sf):
    return state.blank_here(tile_log(spark, sf), F.col("outcome") == "blank").select("seq", "block", "is_blank_here")


@query("SELECT seq, coalesce(max(outcome = 'served') OVER (PARTITION BY layer_id, x >> (z - 12), y >> (z - 12) ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_confirmed_here FROM log", "log")
def confirmed_areas(spark, sf):
    return state.confirmed_here(tile_log(spark, sf), F.col("outcome") == "served").select("seq", "is_confirmed_here")


@query("SELECT layer_id AS id, (x >> (z - 12)) || '/' || (y >> (z - 12)) AS area FROM log GROUP BY ALL HAVING max(outcome = 'blank') AND NOT max(outcome = 'served' AND seq % 9 = 0)", "log")
def empty_areas(spark, sf):
    return state.empty_areas(tile_log(spark, sf), F.col("outcome") == "blank", (F.col("outcome") == "served") & (F.col("seq") % 9 == 0))


@query("SELECT layer_id, max(ts) AS used_at FROM log WHERE outcome = 'served' GROUP BY layer_id HAVING max(ts) >= (SELECT max(ts) FROM log) - INTERVAL 7200 SECOND", "log")
def active_sources(spark, sf):
    log = tile_log(spark, sf)
    return state.active_sources(log, F.col("outcome") == "served", log.agg(F.max("ts").alias("now")).scalar(), 7200)


@query("""SELECT z, x, y, min(ts) AS begun, count(*) AS callers FROM (SELECT *, sum(fresh) OVER (PARTITION BY z, x, y ORDER BY ts, seq) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY z, x, y ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM log)) GROUP BY z, x, y, s""", "log")
def inflight_dedupe(spark, sf):
    return state.shared_requests(tile_log(spark, sf), "6 hours").select("z", "x", "y", "begun", "callers")


@query("SELECT 'u' || seq AS url, ts AS inserted_at FROM log ORDER BY ts DESC, 'u' || seq LIMIT 100", "log")
def cache_trim(spark, sf):
    cache = tile_log(spark, sf).select(F.concat(F.lit("u"), F.col("seq").cast("string")).alias("url"), F.col("ts").alias("inserted_at"))
    return state.cache_keep(cache, 100)


@query("SELECT user_id, ts, l AS \"limit\" FROM (SELECT user_id, ts, event_id, 12 + event_id % 3 AS l, lag(12 + event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> l")
def zoom_limit_changes(spark, sf):
    moves = table(spark, sf, "events").select("user_id", "ts", F.struct("ts", "event_id").alias("at"), (12 + F.col("event_id") % 3).alias("limit"))
    return mosaic.limit_changes(moves, "user_id", "at").select("user_id", "ts", "limit")


@query()
def serve_plan(spark, sf):
    """A session's requests against recorded answers, one after the other, since each answer changes what is asked next."""
    log = tile_log(spark, sf)
    kinds = {"failed": (500, "text/plain", 0), "blank": (200, "image/png", 300), "served": (200, "image/png", 40_000)}
    answer = lambda name, o: F.struct(name.alias("layer_id"), o["s"].alias("status"), o["t"].alias("content_type"), o["b"].alias("bytes"), F.lit(None).cast("string").alias("verdict"))
    outcome = F.element_at(F.create_map(*[x for k, (s, t, b) in kinds.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(b).alias("b")))]), F.col("outcome"))
    last = F.struct(F.lit(FALLBACK).alias("layer_id"), F.lit(200).alias("status"), F.lit("image/jpeg").alias("content_type"), F.lit(20_000).alias("bytes"), F.lit(None).cast("string").alias("verdict"))
    requests = log.select(F.concat(F.lit("s"), (F.col("seq") % 50).cast("string")).alias("session"), "seq", "ts", "z", "x", "y", F.array(answer(F.col("layer_id"), outcome), last).alias("answers"))
    return state.with_holes(state.serve(requests)).select("session", "seq", "served_by", "drawn", F.size("asked").alias("asked"))


@query("SELECT layer_id, max(ts) AS used_at FROM log WHERE outcome = 'served' AND seq % 3 <> 0 GROUP BY layer_id", "log")
def uncredited_prefetch(spark, sf):
    """Every third request was made ahead of need and credits nobody."""
    return state.last_used(tile_log(spark, sf), F.col("outcome") == "served", F.col("seq") % 3 == 0)


@query("SELECT l.layer_id, max(ts) AS used_at FROM log l JOIN lay ON lay.id = l.layer_id AND lay.status = 'active' WHERE outcome = 'served' GROUP BY l.layer_id", "log", "lay")
def recent_in_catalogue(spark, sf):
    log = tile_log(spark, sf)
    return state.active_sources(log, F.col("outcome") == "served", log.agg(F.min("ts").alias("t")).scalar(), 7200, layers(spark, sf).filter("status = 'active'"))


@query("""SELECT z, x, y, min(ts) AS begun, count(*) AS callers, count(*) = count(l) AS abandoned, CASE WHEN count(*) = count(l) THEN max(l) END AS abandoned_at FROM (
  SELECT *, CASE WHEN seq % 4 <> 0 THEN ts + INTERVAL 5 SECOND END AS l, sum(fresh) OVER (PARTITION BY z, x, y ORDER BY ts, seq) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY z, x, y ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM log)) GROUP BY z, x, y, s""", "log")
def abandoned_fetches(spark, sf):
    """Three callers in four leave after five seconds; a fetch that all have left is given up."""
    left = F.when(F.col("seq") % 4 != 0, F.col("ts") + F.make_dt_interval(secs=F.lit(5)))
    return state.shared_fetches(tile_log(spark, sf), "6 hours", left).drop("ended")


@query("SELECT seq, CASE WHEN pz = z THEN x - px ELSE 0 END::DOUBLE AS heading_x, CASE WHEN pz = z THEN y - py ELSE 0 END::DOUBLE AS heading_y FROM (SELECT *, lag(z) OVER q AS pz, lag(x) OVER q AS px, lag(y) OVER q AS py FROM log WINDOW q AS (PARTITION BY layer_id ORDER BY seq))", "log")
def headings(spark, sf):
    return mosaic.headings(tile_log(spark, sf), "layer_id", "seq").select("seq", "heading_x", "heading_y")


@query("SELECT country_here, floor(max(pid % 97 / 7.0) * 10 + 0.5) / 10 AS \"limit\" FROM pts GROUP BY country_here", "pts")
def deepest_zoom(spark, sf):
    return mosaic.zoom_limit(points(spark, sf).withColumn("detail_zoom", F.col("pid") % 97 / 7.0), ["country_here"])


# Pixels


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, v in samples.EXPECTED_TILES) + ") t(tile, verdict)")
def collar_verdict(spark, sf):
    return pixels.verdicts(spark.createDataFrame(samples.tiles(), "tile string, size int, rgba binary")).select("tile", "verdict")


@query("SELECT 'all' AS tile, 128 AS size, 4 AS bytes UNION ALL SELECT 'three', NULL, NULL")
def stitch(spark, sf):
    one = samples.tiles()[0]
    rows = [(t, q, one[1], one[2], 1) for t, n in (("all", 4), ("three", 3)) for q in range(n)]
    return pixels.stitch(spark.createDataFrame(rows, "tile string, quadrant int, size int, rgba binary, bytes long")).select("tile", "size", "bytes")
