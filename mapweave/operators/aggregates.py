"""Groups, counts and the regional hierarchy of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import nuts
from mapweave.functions.services import is_queryable
from mapweave.schema import EU


def group_ids(layers: DataFrame, by: str) -> DataFrame:
    """A row a group: its ids in catalogue order, how many, and where the group first appears."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "id")))
    return layers.groupBy(by).agg(F.transform(listed, lambda x: x["id"]).alias("ids"), F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def stats(layers: DataFrame, collections: int = 0) -> DataFrame:
    """One row: counts by category and service, countries (the Union counts as one), queryable layers, the latest check. One shuffle of group counts."""
    counted = layers.select("category", F.col("service.type").alias("type"), "country", is_queryable().alias("queryable"), "lastVerified").groupBy("category", "type", "country").agg(
        F.count("*").alias("n"), F.count_if("queryable").alias("queryable"), F.max("lastVerified").alias("last")
    )

    def by(column: str) -> DataFrame:
        one = counted.groupBy(column).agg(F.sum("n").alias("n"))
        return one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("m"))

    total = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("layers"), F.lit(collections).alias("collections"), F.countDistinct("country").alias("countries"), F.coalesce(F.sum("queryable"), F.lit(0)).alias("queryable"), F.max("last").alias("lastVerified")
    )
    return total.join(by("category").withColumnRenamed("m", "byCategory")).join(by("type").withColumnRenamed("m", "byService"))


def rollup(layers: DataFrame) -> DataFrame:
    """Layers in each node of the regional tree and below: code, level, layer_count, own_count."""
    scope = F.when(F.col("nuts").isNull() | (F.col("nuts") == F.col("country")), F.array("country")).otherwise(F.concat(F.array("country"), _below("nuts")))
    path = F.when(F.col("country") == EU, F.array(F.lit(EU))).otherwise(F.concat(F.array(F.lit(EU)), scope))
    nodes = layers.select(F.explode(path).alias("code"), F.element_at(path, -1).alias("leaf"))
    return nodes.groupBy("code").agg(F.count("*").alias("layer_count"), F.count_if(F.col("code") == F.col("leaf")).alias("own_count")).withColumn("level", F.when(F.col("code") == EU, -1).otherwise(nuts.level(F.col("code"))))


def _below(code: str):
    """The code's ancestors below its country, then the code. The country stands under its ISO code, so a code of two letters that differs from it is a node of its own."""
    upward = nuts.ancestors(F.col(code))
    return F.concat(F.filter(F.reverse(upward), lambda c: F.length(c) > 2), F.array(code))


def tree(layers: DataFrame) -> DataFrame:
    """Adjacency rows of the tree: code, parent_code, label, level, depth, layer_count; sort by path for depth-first order."""
    named = F.when(F.col("nuts").isNull() | (F.col("nuts") == F.col("country")), F.array("country")).otherwise(F.concat(F.array("country"), _below("nuts")))
    path = F.when(F.col("country") == EU, F.array(F.lit(EU))).otherwise(F.concat(F.array(F.lit(EU)), named))
    steps = layers.select("ord", "regionName", path.alias("path")).select("ord", "regionName", "path", F.posexplode("path").alias("depth", "code"))
    leaf = F.col("depth") == F.size("path") - 1
    label = F.when(leaf & (F.col("depth") >= 2), F.col("regionName"))
    rows = steps.withColumn("trail", F.array_join(F.slice("path", F.lit(1), F.col("depth") + 1), "/")).groupBy("trail").agg(
        F.first("code").alias("code"), F.first("depth").alias("depth"), F.count("*").alias("layer_count"), F.min_by(label, F.when(label.isNotNull(), F.col("ord"))).alias("given"),
        F.first(F.get("path", F.col("depth") - 1)).alias("parent_code"),
    )
    name = F.when(F.col("depth") == 0, F.lit("Europe")).when(F.col("depth") == 1, F.coalesce(nuts.country_name(F.col("code")), F.col("code"))).otherwise(F.coalesce("given", "code"))
    level = F.when(F.col("depth") == 0, -1).when(F.col("depth") == 1, 0).otherwise(nuts.level(F.col("code")))
    return rows.select(F.col("trail").alias("path"), "code", F.when(F.col("depth") > 0, F.col("parent_code")).alias("parent_code"), name.alias("label"), level.alias("level"), "depth", "layer_count")


def in_order(nodes: DataFrame) -> DataFrame:
    """Rows of the tree depth first, siblings by label as readers sort them, not by code point."""
    up = nodes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("of"))
    labels = up.join(nodes.select(F.col("path").alias("of"), "label", "depth"), "of").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "label"))), lambda x: x["label"]).alias("labels"))
    keys = [F.asc_nulls_first(F.collate(F.get("labels", F.lit(i)), "UNICODE")) for i in range(6)]
    return nodes.join(labels, "path").orderBy(*keys, "path").drop("labels")


def health_summary(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"), (F.count_if(~F.col("ok")) > 0).alias("failed"))
