"""What must not grow with the pairs: rows that are sent, sorted or looked at; and that the short lists lose nothing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators import audit, mosaic, ranking, spatial
from mapweave.sources import featureinfo

BOX = "struct<min_lng: double, min_lat: double, max_lng: double, max_lat: double>"
LAYERS = f"id string, ord long, area_km2 double, country string, nuts string, minZoom int, maxZoom int, bbox {BOX}, coverage array<{BOX}>, extents array<{BOX}>, category string, status string, tags array<string>"


def layers_of(spark, boxes, r):
    made = []
    for k, extents in enumerate(boxes):
        made.append((f"l{k}", k, float(r.randrange(1, 9)), r.choice(["EU", "DE", "FR", None]), None, r.choice([0, 3, 8]), 20, extents[0], extents if len(extents) > 1 else None, extents, "orthophoto", "active", []))
    return spark.createDataFrame(made, LAYERS)


def near(spark, n=120, m=60):
    """Layers and points that nearly all meet."""
    r = random.Random(5)
    q = layers_of(spark, [[(r.uniform(4, 4.4), r.uniform(44, 44.4), r.uniform(5.6, 6), r.uniform(45.6, 46))] for _ in range(n)], r)
    return spark.createDataFrame([(i, r.uniform(4.4, 5.6), r.uniform(44.4, 45.6)) for i in range(m)], "pid long, lng double, lat double"), q


def nodes(plan):
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}.get(plan.getClass().getSimpleName())
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(x for c in children for x in nodes(c))]


def run(df):
    """Rows, rows sent through shuffles, and the plan as text."""
    n, plan = len(df.collect()), df._jdf.queryExecution().executedPlan()
    sent = sum(x.metrics().apply("shuffleRecordsWritten").value() for x in nodes(plan) if x.getClass().getSimpleName() == "ShuffleExchangeExec")
    return n, sent, plan.toString()


def test_overlapping_boxes_are_not_sent(spark):
    p, q = near(spark)
    areas = p.select("pid", F.struct(F.col("lng").alias("min_lng"), F.col("lat").alias("min_lat"), (F.col("lng") + 0.3).alias("max_lng"), (F.col("lat") + 0.3).alias("max_lat")).alias("area"))
    n, sent, _ = run(spatial.overlapping(areas, q).select("pid", "id"))
    assert n == 7200 and sent < n / 2


@pytest.mark.parametrize("name", ["layers_for_points", "imagery_stack", "select"])
def test_ranks_are_made_where_layers_are_found(spark, name):
    p, q = near(spark)
    tiles = p.select(F.lit(14).alias("z"), (F.col("pid") + 8420).alias("x"), F.lit(5900).alias("y"))
    made = {
        "layers_for_points": lambda: ranking.layers_for_points(p, q, ["pid"], columns=["id"]), "imagery_stack": lambda: ranking.imagery_stack(p, q, ["pid"], "l3"),
        "select": lambda: mosaic.select(tiles, q.withColumn("mosaic_ord", F.col("ord").cast("int")), "l3"),
    }
    n, sent, plan = run(made[name]())
    assert n > 4000 and sent < n / 2 and "Window" not in plan


@pytest.mark.parametrize("name", ["best_source", "best_for"])
def test_the_first_layer_needs_no_pairs(spark, name):
    """Of layers that hold the whole cell only the first is looked at, and none is sorted with its points."""
    p, q = near(spark)
    tiles = p.select(F.lit(14).alias("z"), (F.col("pid") + 8420).alias("x"), F.lit(5900).alias("y"))
    plan = run(ranking.best_source(p, q, ["pid"], "l3") if name == "best_source" else mosaic.best_for(tiles, q.withColumn("mosaic_ord", F.col("ord").cast("int")), None))[2]
    assert "Window" not in plan and "SortMergeJoin" not in plan
    wide = layers_of(spark, [[(0.0, 40.0, 10.0 + k, 50.0)] for k in range(50)], random.Random(1))
    for top, longest in (([], 1), (["country"], 4), (None, 50)):
        assert spatial.lists(wide, ranking.ORDER, ["id"], 1.0, top).filter("cx = 5 AND cy = 45").select(F.size("listed")).first()[0] <= longest


def test_contested_pairs_are_not_sent(spark):
    q = near(spark, 200)[1]
    n, sent, _ = run(audit.contested(q))
    assert n > 10_000 and sent < n / 2


def test_layers_of_equal_extents_are_counted_once(spark):
    """Copies of three shapes: as many findings as by all pairs, of which only six kinds are counted."""
    shapes = [[(0.0, 40.0, 4.0, 43.0)], [(1.0, 41.0, 5.0, 44.0)], [(0.0, 40.0, 1.5, 44.0), (3.0, 40.0, 4.0, 44.0)]]
    q = layers_of(spark, [shapes[k % 3] for k in range(60)], random.Random(2))
    assert spatial.paired(audit._groups(q), "first", "bbox", True, itself=True).count() == 6
    got = {(r.winner, r.loser): r.contested for r in audit.contested(q).collect()}
    rows = [r.asDict(True) for r in q.collect()]
    area = lambda b: (b["max_lng"] - b["min_lng"]) * (b["max_lat"] - b["min_lat"]) * math.cos(math.radians((b["min_lat"] + b["max_lat"]) / 2))
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["country"] == b["country"]:
                continue
            s, t = a["bbox"], b["bbox"]
            w, e, lo, hi = max(s["min_lng"], t["min_lng"]), min(s["max_lng"], t["max_lng"]), max(s["min_lat"], t["min_lat"]), min(s["max_lat"], t["max_lat"])
            inside = lambda x, y, extents: any(v["min_lng"] <= x <= v["max_lng"] and v["min_lat"] <= y <= v["max_lat"] for v in extents)
            n = sum(inside(w + (e - w) * i / 12, lo + (hi - lo) * j / 12, a["extents"]) and inside(w + (e - w) * i / 12, lo + (hi - lo) * j / 12, b["extents"]) for i in range(13) for j in range(13))
            small, large = (a, b) if area(s) < area(t) else (b, a)
            want |= {(small["id"], large["id"]): n} if n else {}
    assert got == want and len(got) > 500


@pytest.mark.parametrize("seed", [1, 2])
def test_short_lists_lose_nothing(spark, seed):
    """Boxes of all sizes, some across the antimeridian or over the whole world, ties of area, unknown and strange countries, zooms."""
    r = random.Random(seed)
    box = lambda size: (w := r.randrange(-200, 178) / 1.0, s := r.randrange(-90, 88) / 1.0, w + r.choice([0.5, 1, 2, size]), min(90.0, s + r.choice([0.5, 1, 2, size])))
    boxes = [[box(r.choice([3, 9, 20])) for _ in range(r.choice([1, 1, 2]))] for _ in range(250)] + [[(170.0, -20.0, -170.0, 20.0)], [(-180.0, -90.0, 180.0, 90.0)]]
    q = layers_of(spark, boxes, r)
    p = [(i, r.randrange(-360, 361) / 2, r.randrange(-180, 181) / 2, r.choice([None, "", "DE", "EU", "XX"])) for i in range(400)] + [(400, 195.0, 1.0, None), (401, -199.5, 1.0, "DE"), (402, None, 2.0, None)]
    points = spark.createDataFrame(p, "pid long, lng double, lat double, here string")
    rows = q.collect()

    def met(lng, lat):
        hold = lambda b: lng is not None and b.min_lat <= lat <= b.max_lat and (b.min_lng <= lng <= b.max_lng if b.min_lng <= b.max_lng else lng >= b.min_lng or lng <= b.max_lng)
        return sorted((x for x in rows if any(map(hold, x.extents))), key=lambda x: (x.area_km2, x.ord))

    local = lambda x, here: not here or x.country in (here, "EU")
    best = {r.pid: r.best for r in ranking.best_source(points, q, ["pid"], "l0", "here").collect()}
    assert best == {i: next((x.id for x in met(lng, lat) if local(x, here)), "l0") for i, lng, lat, here in p}
    stack = {}
    for x in ranking.imagery_stack(points, q, ["pid"], "l0", "here").orderBy("pid", "nth").collect():
        stack.setdefault(x.pid, []).append(x.id)
    assert stack == {i: [*(x.id for x in met(lng, lat) if local(x, here) and x.id != "l0"), "l0", *(x.id for x in met(lng, lat) if not local(x, here) and x.id != "l0")] for i, lng, lat, here in p}
    ranked = {(r.pid, r.nth): r.id for r in ranking.layers_for_points(points, q, ["pid"], columns=["id"]).collect()}
    assert ranked == {(i, k + 1): x.id for i, lng, lat, _ in p for k, x in enumerate(met(lng, lat))}
    tiles = spark.createDataFrame([(z, r.randrange(2**z), r.randrange(2**z)) for z in (4, 7, 9) for _ in range(150)], "z int, x long, y long").distinct()
    drawn = q.withColumn("mosaic_ord", F.col("ord").cast("int"))
    for fallback in ("l0", None):
        first = mosaic.select(tiles, drawn, fallback, from_zoom=6).filter("nth = 1").select("z", "x", "y", "id")
        assert sorted(map(tuple, mosaic.best_for(tiles, drawn, fallback, from_zoom=6).collect())) == sorted(map(tuple, first.collect()))


def test_a_full_cell_is_dealt_out(spark):
    p, q = near(spark)
    cells = p.withColumn("cx", F.floor(F.col("lng") / 2).cast("int")).withColumn("cy", F.floor(F.col("lat") / 2).cast("int"))
    listed = spatial.lists(q, ranking.ORDER, ["id"])
    dealt = spatial.meet(cells, listed, "left", per_slot=10).select("pid", F.size("listed").alias("n"), F.spark_partition_id().alias("part")).collect()
    assert sorted(r.pid for r in dealt) == list(range(60)) and {r.n for r in dealt} == {120} and len({r.part for r in dealt}) > 1


def test_answers_are_dealt_out_and_read_once(spark):
    """One file is one partition; its answers are read in many. No filter reads them a second time."""
    rows = spark.range(0, 300, 1, 1).selectExpr("id", "concat('<table><tr><th>a</th><td>', id, ' &amp; b</td></tr></table>') AS body", "'text/html' AS content_type")
    parsed = featureinfo.parse(rows).select("id", F.posexplode("features").alias("nth", "f"))
    filters = [x for x in parsed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("split(" in x for x in filters)
    got = parsed.select("id", F.element_at("f.properties", "a").alias("a"), F.spark_partition_id().alias("part")).collect()
    assert {(r.id, r.a) for r in got} == {(i, f"{i} & b") for i in range(300)} and len({r.part for r in got}) > 1
