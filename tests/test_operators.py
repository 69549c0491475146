"""Operators over layers: plans, properties, documents, answers, pixels, reports, state."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mapweave.functions import boxes
from mapweave.functions.boxes import Box
from mapweave.operators import adapters, aggregates, country, mosaic, pixels, ranking, spatial
from mapweave.plans import samples
from mapweave.plans.queries import QUERIES
from mapweave.plans.derived import FALLBACK, layers, outlines, points, tile_log
from mapweave.schema import CATEGORIES, LAYER_KEYS, SERVICES
from mapweave.sources import capabilities, collections, featureinfo, http, outlines as outline_source, reports
from mapweave.streaming import state

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def world(spark, n=300, seed=1):
    """Points, and boxes of all kinds: across the antimeridian, on the poles, degenerate, several to a layer."""
    r = random.Random(seed)
    p = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(n)] + [(n, 180.0, 0.0), (n + 1, -180.0, 0.0), (n + 2, 10.0, 90.0), (n + 3, 20.0, -90.0)]
    made = []
    for k in range(60):
        boxes = []
        for _ in range(r.randrange(1, 4)):
            w, s = r.uniform(-180, 170), r.uniform(-90, 80)
            boxes.append((w, s, r.uniform(w, 180), r.uniform(s, 90)))
        if k % 7 == 0:
            boxes = [(r.uniform(150, 180), -40.0, r.uniform(-180, -120), 40.0)]
        made.append((f"l{k}", boxes))
    made += [("point", [(p[0][1], p[0][2], p[0][1], p[0][2])]), ("all", [(-180.0, -90.0, 180.0, 90.0)])]
    return spark.createDataFrame(p, "pid long, lng double, lat double"), spark.createDataFrame(made, "id string, extents array<struct<min_lng: double, min_lat: double, max_lng: double, max_lat: double>>")


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_join_is_the_plain_join(spark, seed):
    p, q = world(spark, seed=seed)
    plain = rows(spatial.covering_plain(p, q).select("pid", "id"))
    assert rows(spatial.covering_grid(p, q).select("pid", "id")) == plain and len(plain) > 300
    assert rows(spatial.covering_grid(p.repartition(7), q, cell=11.0).select("pid", "id")) == plain


@pytest.mark.parametrize("cell", [2.0, 17.0])
def test_box_joins_are_those_of_all_pairs(spark, cell):
    r = random.Random(4)
    sides = [sorted((r.uniform(-90, 90), r.uniform(-90, 90))) for _ in range(150)]
    areas = [(i, (r.uniform(-180, 180), s, r.uniform(-180, 180), n)) for i, (s, n) in enumerate(sides)]  # half of them are inverted
    areas += [(200, (5.0, 5.0, 5.0, 5.0)), (200, (5.0, 5.0, 5.0, 5.0)), (201, (-180.0, -90.0, 180.0, 90.0)), (202, (170.0, 80.0, 200.0, 95.0)), (203, (4.0, 4.0, 6.0, 6.0)), (204, (6.0, 4.0, 8.0, 6.0))]
    a = spark.createDataFrame(areas, "pid long, area struct<min_lng: double, min_lat: double, max_lng: double, max_lat: double>")
    q = world(spark, seed=3)[1]
    for f, test in ((spatial.overlapping, boxes.any_overlaps), (spatial.containing, boxes.any_contains_box)):
        plain = rows(a.join(q, test(F.col("extents"), Box.of("area"))).select("pid", "id"))
        assert rows(f(a, q, cell=cell).select("pid", "id")) == plain and len(plain) > 50
    numbered = a.withColumn("ord", F.row_number().over(Window.orderBy("pid")))
    x, y = Box.of("x.area"), Box.of("y.area")
    met = numbered.alias("x").join(numbered.alias("y"), (F.col("x.ord") < F.col("y.ord")) & x.overlaps(y)).select("x.ord", "y.ord")
    assert rows(spatial.box_pairs(numbered, box="area", cell=cell)) == rows(met) and met.count() > 1000
    wide = (F.least(x.e, y.e) > F.greatest(x.w, y.w)) & (F.least(x.n, y.n) > F.greatest(x.s, y.s))
    met = numbered.alias("x").join(numbered.alias("y"), (F.col("x.ord") < F.col("y.ord")) & wide).select("x.ord", "y.ord")
    assert rows(spatial.box_pairs(numbered, box="area", area=True, cell=cell)) == rows(met)


@pytest.mark.parametrize("name", ["best_source", "best_source_in_country", "imagery_stack", "layers_for_point", "covering_grid", "extent_overlap", "extent_contains", "contested_grid", "winner_conflicts", "bbox_algebra", "tile_select", "country_at_tolerant"])
def test_no_plan_compares_every_pair(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ranking_does_not_depend_on_partitions(spark):
    a = ranking.best_source(points(spark, SF), layers(spark, SF), ["pid"], FALLBACK)
    b = ranking.best_source(points(spark, SF).repartition(13), layers(spark, SF).repartition(5), ["pid"], FALLBACK)
    assert rows(a) == rows(b)
    none = ranking.best_source(points(spark, SF).limit(3), layers(spark, SF).limit(0), ["pid"], None)
    assert [r.best for r in none.collect()] == [None] * 3


def test_best_and_stack_agree(spark):
    p, q = points(spark, SF), layers(spark, SF)
    best = {r.pid: r.best for r in ranking.best_source(p, q, ["pid"], FALLBACK, "country_here").collect()}
    heads = ranking.imagery_stack(p, q.filter("category <> 'satellite' OR id = 'l.000005'"), ["pid"], FALLBACK, "country_here").filter("nth = 1")
    assert all(best[r.pid] == r.id for r in heads.collect())


def test_scalar_filters_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/layers"
    layers(spark, SF).write.parquet(path)
    from mapweave.operators.filters import Query, find

    plan = find(spark.read.parquet(path), Query(country="DE", status="active", text="a")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country,DE)" in plan and "EqualTo(status,active)" in plan and "license" not in plan.split("ReadSchema")[1]


def test_countries(spark):
    shapes = outlines(spark, SF)
    p = points(spark, SF)
    strict = country.country_at(p, shapes, ["pid"], 0)
    near = country.country_at(p, shapes, ["pid"], 50)
    a, b = ({r.pid: r.country for r in d.collect()} for d in (strict, near))
    assert all(b[i] == c for i, c in a.items() if c) and sum(x is not None for x in b.values()) > sum(x is not None for x in a.values())
    assert country.is_in_country(p, shapes, ["pid"], "AT").filter("inside").count() == sum(c == "AT" for c in country_values(p, shapes))


def country_values(p, shapes):
    return [r.country for r in country.country_at(p, shapes, ["pid"]).collect()]


def test_rings_as_text_and_back(spark):
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    ring = [(6.62, 35.49), (18.52, 36.0), (-18.0, 47.09), (-6.62, -0.01)]
    coded = outline_source.encode_ring(ring, alphabet)
    assert [(p["lng"], p["lat"]) for p in outline_source.decode_ring(coded, alphabet)] == ring
    df = spark.createDataFrame([("IT", 0, 0, coded)], "iso string, shape int, ring int, text string")
    assert len(outline_source.decoded(df, alphabet).first().points) == 4


def test_detail_zoom_respects_blank_ground(spark):
    p = spark.createDataFrame([(1, 11.25, 43.77), (2, -60.0, -50.0)], "pid long, lng double, lat double")
    base = layers(spark, SF).limit(1).drop("id", "ord", "extents", "minZoom", "maxZoom", "resolutionMeters", "country", "area_km2")
    box = lambda *v: F.array(F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("min_lng", "min_lat", "max_lng", "max_lat"), strict=True)]))
    made = None
    for i, (name, ext, top, res) in enumerate([("region", (9, 42, 13, 45), 22, 0.2), ("nation", (6, 35, 19, 47), 21, 0.5), ("base", (-180, -90, 180, 90), 14, 10.0)]):
        one = base.withColumn("id", F.lit(name)).withColumn("ord", F.lit(i)).withColumn("extents", box(*ext)).withColumn("minZoom", F.lit(0)).withColumn("maxZoom", F.lit(top)).withColumn("resolutionMeters", F.lit(res)).withColumn("country", F.lit("IT")).withColumn("mosaic_ord", F.lit(i))
        made = one if made is None else made.unionByName(one)
    got = {r.pid: r for r in mosaic.detail_zoom(p, made, made, "base", ["pid"]).collect()}
    assert got[1].best == "region" and got[1].detail_zoom > 19.5 and got[2].best == "base" and got[2].detail_zoom == 14
    from mapweave.functions import mercator

    x, y = mercator.tile_of(F.lit(11.25), F.lit(43.77), F.lit(21))
    empty = spark.range(1).select(F.lit("region").alias("id"), mercator.area_key(x, y, F.lit(21)).alias("area"))
    assert mosaic.detail_zoom(p, made, made, "base", ["pid"], empty_areas=empty).filter("pid = 1").first().best == "nation"


def test_prefetch_still_and_moving(spark):
    t = spark.createDataFrame([(5, 31, 0, 1.0, 0.0), (5, 10, 10, 0.0, 0.0)], "z int, x long, y long, heading_x double, heading_y double")
    got = mosaic.prefetch_ahead(t)
    assert got.filter("y = 10").count() == 8 and {(r.px, r.py) for r in got.filter("y = 0").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_collections(spark):
    built, found = collections.build(collections.documents(spark, samples.COLLECTIONS))
    assert set(built.columns) >= {"extents", "area_km2", "is_tiled", "ord"} and found.filter("message like '%belongs to IT%'").count() == 1
    it = {r.id: r for r in built.collect()}
    assert it["it.one"].service.wms.crs == ["EPSG:3857", "EPSG:4326"] and it["it.one"].service.wms.version == "1.3.0" and it["gr.greece"].service.wmts.crs == "EPSG:3857" and it["it.two"].service.xyz.scheme == "xyz"
    with pytest.raises(ValueError, match="not valid"):
        collections.build_strict(collections.documents(spark, samples.COLLECTIONS))
    catalogue, accepted, issues = collections.register(layers(spark, SF), collections.documents(spark, samples.RUNTIME))
    assert [r.id for r in accepted.collect()] == ["xx.runtime.one"] and issues.filter("message like 'Duplicate%'").count() == 1
    assert catalogue.orderBy(F.col("ord").desc()).first().id == "xx.runtime.one"
    broken = collections.issues(collections.documents(spark, [("x", "not json")]))
    assert {r.path for r in broken.collect()} == {"scope", "title", "layers"}


def test_collections_from_files(spark, tmp_path):
    for name, body in samples.COLLECTIONS[:2]:
        (tmp_path / name).write_text(body)
    docs = collections.read(spark, [f"{tmp_path}/gr.json", f"{tmp_path}/it.json"])
    assert [r.id for r in collections.build(docs)[0].orderBy("ord").collect()] == ["gr.greece", "it.one", "it.two"]
    collections.write(collections.read(spark, [f"{tmp_path}/gr.json"]), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_wms_documents(spark):
    docs = spark.createDataFrame([("new", samples.WMS_130, "https://e.example/wms"), ("old", samples.WMS_111, None)], "doc_id string, xml string, url string")
    got = {(r.doc_id, r.name): r for r in capabilities.parse_wms(docs).collect()}
    root, parcels, zoning, detail = (got["new", n] for n in (None, "parcels", "zoning", "detail"))
    assert tuple(root.bbox) == (3.5, 41.25, 9.75, 51.5) and root.boxes[0].raw == [41.25, 3.5, 51.5, 9.75] and root.boxes[0].bbox == [3.5, 41.25, 9.75, 51.5]
    assert (parcels.min_scale, parcels.max_scale, parcels.queryable, parcels.path, parcels.depth) == (300, 15000, True, ["Root"], 1) and root.service.title == "Parcels & zones"
    assert not zoning.queryable and zoning.dimensions[0].default == "2020" and detail.dimensions == zoning.dimensions and detail.title == "detail" and parcels.get_map.url == "https://e.example/wms"
    ortho = got["old", "ortho"]
    assert ortho.version == "1.1.1" and ortho.crs == ["EPSG:4326", "EPSG:3003", "EPSG:3857"] and tuple(ortho.bbox) == (10, 43, 11, 44) and abs(ortho.min_scale - 707.1) < 0.1 and ortho.dimensions[0].values == "2000/2001"
    codes = {r.doc_id: r.error_code for r in capabilities.parse_wms(spark.createDataFrame(samples.BROKEN, "doc_id string, xml string")).collect()}
    assert codes == {"empty": "CAPABILITIES_PARSE_ERROR", "broken": "CAPABILITIES_PARSE_ERROR", "page": "CAPABILITIES_PARSE_ERROR", "refused": "SERVICE_EXCEPTION", "entities": "CAPABILITIES_PARSE_ERROR"}
    many = "".join(f"<Layer><Name>l{i}</Name><Title>a &amp; {i}</Title></Layer>" for i in range(600))
    big = samples.WMS_130.replace("<Layer><Name>detail</Name></Layer>", many)
    found = capabilities.parse_wms(spark.createDataFrame([("big", big)], "doc_id string, xml string"))
    last = capabilities.find_layer(found, "l599").first()
    assert found.filter("name like 'l%'").count() == 600 and last.title == "a & 599" and tuple(last.bbox) == (3.5, 41.25, 9.75, 51.5)


def test_wmts_documents(spark):
    r = capabilities.parse_wmts(spark.createDataFrame([("a", samples.WMTS), ("b", "<x/>")], "doc_id string, xml string")).orderBy("doc_id").collect()
    assert tuple(r[0].bbox) == (-12.5, 38, 27, 63) and r[0].matrix_sets["web"].crs == "EPSG:3857" and (r[0].matrix_sets["degrees"].matrices[0].left, r[0].matrix_sets["degrees"].matrices[0].top) == (-180, 90) and r[1].error_code == "CAPABILITIES_PARSE_ERROR"


def answer(url, headers, timeout):
    if "slow" in url:
        raise TimeoutError
    if "down" in url:
        return 503, "text/html", b"busy"
    if "GetCapabilities" in url:
        return 200, "text/xml", samples.WMS_130.encode()
    if "GetFeatureInfo" in url:
        return 200, "text/plain", b"lot = 7"
    return 200, "image/png", b"png"


def test_sweeps(spark):
    ends = spark.createDataFrame([(0, "https://a.example/wms"), (1, "https://down.example/"), (2, "https://slow.example/"), (3, "https://a.example/wms")], "idx int, url string")
    got = http.check(ends, answer).collect()
    assert [r.idx for r in got] == [0, 1, 2, 3] and [r.ok for r in got] == [True, False, False, True] and got[0].layer_count == 3 and got[0].queryable_layer_count == 1
    assert got[1].status == 503 and got[1].error_code == "ENDPOINT_UNAVAILABLE" and "timed out" in got[2].error
    q = layers(spark, SF)
    tiles = http.tiles(q, http.probe_requests(q), answer)
    assert tiles.filter("error IS NULL").count() == tiles.filter("service_ok IS NULL OR true" if "service_ok" in tiles.columns else "url IS NOT NULL").count()
    clickable = q.filter("service.type = 'WMS' AND service.wms.queryable")
    corner = clickable.select(F.col("extents")[0]["min_lng"].alias("lng"), F.col("extents")[0]["min_lat"].alias("lat"))
    clicks = http.clicks(q, corner, answer).collect()
    assert len(clicks) >= clickable.count() > 0 and all(r.features[0].properties == {"lot": "7"} for r in clicks)
    assert http.clicks(q, spark.createDataFrame([(-170.0, -80.0)], "lng double, lat double"), answer).count() == 0
    summary = aggregates.health_summary(http.check(ends, answer)).first()
    assert (summary.ok, summary.total, summary.failed) == (2, 4, True)


def test_reports_and_adapters(spark):
    q = layers(spark, "/root/testdata/sf0.01")
    said = reports.catalogue(q)
    assert said.startswith("# Catalogue") and "## EU" in said and said.index("## EU") < said.index("## Tree")
    import json

    style = json.loads(adapters.style(q, "Map").first().style)
    assert style["version"] == 8 and len(style["layers"]) == len(style["sources"]) and all("maxzoom" not in x for x in style["layers"])
    own = spark.createDataFrame([("mapweave://a.b/3/2/1",), ("other://x",)], "u string").select(adapters.parse_own(F.col("u")).alias("p")).collect()
    assert tuple(own[0].p) == ("a.b", 3, 2, 1) and own[1].p is None
    assert json.loads(adapters.backdrop(spark, "data:,", [(0, 1), (1, 1), (1, 0), (0, 0)], "c").first().source)["type"] == "image"


def test_collars():
    for (name, n, raw), (_, verdict) in zip(samples.tiles()[:4], samples.EXPECTED_TILES[:4], strict=True):
        got, share, out = pixels.inspect(np.frombuffer(raw, np.uint8).reshape(n, n, 4))
        assert got == verdict, name
        if name == "third":
            assert 0.3 < share < 0.4 and (out[:, :20, 3] == 0).all() and (out[:, 22:, 3] == 255).all()
    mask = np.zeros((9, 9), bool)
    mask[0, 0] = mask[0, 1] = mask[1, 1] = mask[2, 1] = mask[2, 2] = mask[5, 5] = True  # a winding path, and an island
    assert pixels.collar(mask).sum() == 5


def serve_rows(spark, steps, **options):
    kind = "array<struct<layer_id: string, status: int, content_type: string, bytes: long, verdict: string>>"
    data = [("s", i, f"2026-01-01 00:{m:02d}:00", z, x, y, a) for i, (m, z, x, y, a) in enumerate(steps)]
    df = spark.createDataFrame(data, f"session string, seq long, ts string, z int, x long, y long, answers {kind}").withColumn("ts", F.col("ts").cast("timestamp"))
    return [(r.served_by, r.asked) for r in state.serve(df, **options).orderBy("seq").collect()]


def test_serving_learns(spark):
    good = lambda n, b=32768: (n, 200, "image/jpeg", b, None)
    down, gap, page, blank = ("r", 500, "text/plain", 0, None), ("r", 404, "text/html", 0, None), ("r", 200, "text/xml", 50, None), good("r", 300)
    nation, base = good("n"), good("b", 200)
    assert serve_rows(spark, [(0, 14, 5, 5, [down, nation, base]), (0, 14, 50, 5, [good("r"), nation, base]), (2, 14, 90, 5, [good("r"), nation, base])]) == [("n", ["r", "n"]), ("n", ["n"]), ("r", ["r"])]
    assert serve_rows(spark, [(0, 14, 5, 5, [page, nation, base])]) == [("n", ["r", "n"])]
    assert serve_rows(spark, [(0, 14, 4, 4, [blank, nation]), (0, 14, 5, 5, [good("r"), nation]), (0, 14, 44, 44, [good("r"), nation])]) == [("n", ["r", "n"]), ("n", ["n"]), ("r", ["r"])]
    assert serve_rows(spark, [(0, 14, 4, 4, [gap, nation]), (0, 14, 400, 4, [good("r"), nation])])[1] == ("r", ["r"])
    assert serve_rows(spark, [(0, 14, 4, 4, [good("r"), nation]), (0, 19, 4 << 5, 4 << 5, [good("r", 900), nation])])[1] == ("r", ["r"])
    assert serve_rows(spark, [(0, 14, 4, 4, [base])]) == [("b", ["b"])] and serve_rows(spark, [(0, 14, 4, 4, [blank])], holes=True) == [(None, ["r"])]
    assert serve_rows(spark, [(0, 14, 4, 4, [good("r")]), (0, 14, 4, 4, [down])]) == [("r", ["r"]), ("r", [])]


def test_streams_are_the_batch(spark, tmp_path):
    spark.conf.set(*state.STATE_STORE)
    log = tile_log(spark, SF).limit(400).withColumn("failed", F.col("outcome") == "failed").withColumn("blank", F.col("outcome") == "blank")
    log.orderBy("ts", "seq").coalesce(1).write.parquet(f"{tmp_path}/log")
    batch = spark.read.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/log")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = run(state.failing_stream(stream, 3600), "failing")
    want = state.failing(batch, F.col("failed"), 3600)
    assert rows(got.select("seq", "is_failing")) == rows(want.select("seq", "is_failing"))
    assert run(state.distinct_stream(stream.select("ts", "z", "x", "y")), "tiles").count() == batch.select("z", "x", "y").distinct().count()
    assert run(state.blank_blocks_stream(stream), "blocks").count() > 0
    assert run(state.usage_stream(stream.filter("outcome = 'served'"), "1 hour"), "usage").count() >= 0


def test_schema_of_documents():
    import json

    schema = json.loads(collections.json_schema())
    layer = schema["properties"]["layers"]["items"]
    assert set(layer["properties"]) == set(LAYER_KEYS) and not layer["additionalProperties"] and layer["properties"]["category"]["enum"] == CATEGORIES
    assert [x["properties"]["type"]["const"] for x in layer["properties"]["service"]["oneOf"]] == SERVICES and layer["properties"]["bbox"]["minItems"] == 4
    assert layer["properties"]["service"]["oneOf"][0]["properties"]["options"]["required"] == ["layers"]


def test_tree_in_readers_order(spark):
    rows = [("EU", "Europe", 0), ("EU/AT", "Österreich", 1), ("EU/PL", "Polska", 1), ("EU/NL", "nederland", 1), ("EU/PL/PL2", "Śląsk", 2), ("EU/PL/PL9", "Mazowsze", 2), ("EU/PL/PL6", "Żuławy", 2)]
    tree = spark.createDataFrame(rows, "path string, label string, depth int").repartition(4)
    assert [r.path for r in aggregates.in_order(tree).collect()] == ["EU", "EU/NL", "EU/AT", "EU/PL", "EU/PL/PL9", "EU/PL/PL2", "EU/PL/PL6"]


def test_findings_by_share(spark):
    got = QUERIES["findings_by_share"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) > 10 and [r.contested_share for r in got] == sorted((r.contested_share for r in got), reverse=True)


def test_resolvers(spark):
    p = points(spark, SF)
    named = lambda value: lambda points, by: points.withColumn("country", F.lit(value))
    shown = lambda **o: ranking.with_country(p, ["pid"], **o).select("resolved").distinct().first()[0]
    assert shown() is None
    ranking.set_resolver(named("IT"))
    try:
        assert (shown(), shown(resolver=named("FR")), shown(resolver=False)) == ("IT", "FR", None)
    finally:
        ranking.set_resolver(None)


def test_failures_in_a_busy_layer(spark):
    """One layer with nine tenths of the log: spans of time give what one window over it gives."""
    r = random.Random(6)
    data = [("busy" if r.random() < 0.9 else f"l{r.randrange(5)}", i, 1_000_000_000 + r.randrange(4000) / 4, r.random() < 0.02) for i in range(3000)]
    log = spark.createDataFrame(data, "layer_id string, seq long, t double, failed boolean").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    last = F.max(F.when(F.col("failed"), F.col("ts"))).over(Window.partitionBy("layer_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1))
    for ttl in (1, 7, 60):
        plain = log.select("seq", F.coalesce(F.col("ts") <= last + F.make_dt_interval(secs=F.lit(ttl)), F.lit(False)))
        assert rows(state.failing(log, F.col("failed"), ttl).select("seq", "is_failing")) == rows(plain)


def test_text_answers_in_odd_shapes(spark):
    bodies = {
        "Results for FeatureType 'a':\n---\nx = 1\ny=2\nx = 3\n-----\nResults for FeatureType 'b'\n----\nx= 4 = 5\n---\n= 6\n": [("a", {"y": "2", "x": "3"}), ("b", {"x": "4 = 5"})],
        "x = 1\r\nResults for FeatureType 'late':\r\ny = 2\r\n--\r\n": [("late", {"x": "1", "y": "2"})],
        "results for featuretype plain\n---\n---\nk=\n": [("plain", {"k": ""})],
        "nothing here\n----\n": [],
        "a = 1\n" + "---\nb = 2\n" * 300: [(None, {"a": "1"})] + [(None, {"b": "2"})] * 300,
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for r in df.select("body", featureinfo.text_features(F.col("body")).alias("f")).collect():
        assert [(f.layer, f.properties) for f in r.f] == bodies[r.body]


def test_html_answers_in_odd_shapes(spark):
    bodies = {
        "<TABLE><TR><TD>a</TD><TD>1</TD></TR><tr><td>a</td><td>2</td></tr><tr><td></td><td>3</td></tr></TABLE>": [{"a": "2"}],
        "<table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>": [{"a": "1", "b": "2"}],
        "<table><tr><th>a</th><td><a href='x>y'>1</a></td></tr></table><table><tr><td>b</td><td>2</td></tr></table>": [{"a": "y'>1"}, {"b": "2"}],
        "<table><tr><td>a</td><td>1</td></tr>": [], "<p>none</p>": [],
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for r in df.select("body", featureinfo.html_features(F.col("body")).alias("f")).collect():
        assert [f.properties for f in r.f] == bodies[r.body]


def test_protocols_end_to_end(spark):
    q = layers(spark, SF)
    ids = [r.id for r in q.filter("service.type IN ('WMTS', 'XYZ', 'WMS')").orderBy("ord").limit(3).collect()]

    def get(url, headers, timeout):
        return (503, "text/html", b"") if f"layer_{int(ids[0][2:])}" in url.split("&")[0] + url else (200, "image/png", url.encode())

    asked = spark.createDataFrame([(f"mapweave://{ids[1]}/3/2/1",), (f"mapweave://{ids[0]}/3/2/1",), ("mapweave://none/3/2/1",), ("other",), (f"mapweave://{ids[1]}/3/2/1",)], "url string")
    got = {r.url: r for r in http.protocol_tiles(asked, q, get).collect()}
    assert http.protocol_tiles(asked, q, get).count() == 5
    assert got[f"mapweave://{ids[1]}/3/2/1"].body and got[f"mapweave://{ids[0]}/3/2/1"].error.startswith("503")
    assert got["mapweave://none/3/2/1"].error == "no such layer: none" and got["other"].error == "not a tile URL"
    chain = spark.createDataFrame([(3, 2, 1, 1, ids[0]), (3, 2, 1, 2, ids[1]), (3, 2, 2, 1, ids[0])], "z int, x long, y long, nth int, id string")
    asked = spark.createDataFrame([("mapweave-mosaic://m/3/2/1",), ("mapweave-mosaic://m/3/2/2",), ("mapweave-mosaic://m/3/5/5",)], "url string")
    got = {r.url[-3:]: (r.served_by, r.cache_control, r.body is not None) for r in http.mosaic_tiles(asked, chain, q, get).collect()}
    assert got == {"2/1": (ids[1], None, True), "2/2": (None, "no-store", False), "5/5": (None, "no-store", False)}


def test_cache_is_read_through(spark):
    log = spark.sparkContext.accumulator(0)

    def get(url, headers, timeout):
        log.add(1)
        return (200, "image/png", b"new") if "new" in url else (200, "text/html", b"no")

    cache = spark.createDataFrame([("https://old.example/", "image/png", b"old", "2026-01-01")], "url string, content_type string, body binary, inserted_at string")
    wanted = spark.createDataFrame([(u,) for u in ("https://old.example/", "https://new.example/", "https://bad.example/")], "url string")
    found, entries = http.cached_tiles(wanted, cache, get)
    assert {(r.url, bytes(r.body) if r.body else None, r.from_cache) for r in found.collect()} == {("https://old.example/", b"old", True), ("https://new.example/", b"new", False), ("https://bad.example/", None, False)}
    assert log.value == 2 and [r.url for r in entries.collect()] == ["https://new.example/"]


def test_tiles_are_told_as_they_come(spark, tmp_path):
    spark.createDataFrame([(i, "l1") for i in range(7)], "seq long, layer_id string").write.json(f"{tmp_path}/in")
    told = []
    stream = spark.readStream.schema("seq long, layer_id string").json(f"{tmp_path}/in")
    running = state.on_tile(stream, lambda batch, n: told.extend(r.seq for r in batch.collect()), checkpointLocation=f"{tmp_path}/state")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(told) == list(range(7))
