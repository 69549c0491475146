"""Reports over a catalogue as Markdown: aggregated and sorted by Spark, formatted on the driver (a catalogue is small)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.aggregates import stats, tree

#: Rows that a report may have.
MOST = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report has {MOST} rows at most")
    return rows


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def catalogue(layers: DataFrame) -> str:
    """Counts, layers by country (the Union first), and the tree."""
    s = stats(layers).first()
    listed = layers.select("country", "title", "category", F.col("service.type").alias("service"), "resolutionMeters", "status", "id").orderBy((F.col("country") == "EU").desc(), "country", F.collate("title", "UNICODE"))
    parts = [f"# Catalogue\n\n{s['layers']} layers, {s['countries']} countries.\n"]
    for name, counted in (("Category", s["byCategory"]), ("Service", s["byService"])):
        parts.append(_table([name, "Layers"], [list(x) for x in sorted((counted or {}).items(), key=lambda kv: (-kv[1], kv[0]))]) + "\n")
    by_country: dict[str, list] = {}
    for r in _rows(listed):
        by_country.setdefault(r["country"], []).append([r["title"], r["category"], r["service"], r["resolutionMeters"], r["status"], f"`{r['id']}`"])
    parts += [f"## {c}\n\n" + _table(["Title", "Category", "Service", "Resolution (m)", "Status", "Id"], rows) + "\n" for c, rows in by_country.items()]
    nodes = _rows(tree(layers).orderBy("path"))
    parts.append("## Tree\n\n" + "\n".join(f"{'  ' * r['depth']}- {r['label']} ({r['layer_count']})" for r in nodes) + "\n")
    return "\n".join(parts)


def verification(health: DataFrame, tiles: DataFrame) -> DataFrame:
    """A row a layer: whether its endpoint answers and its probe tile is an image. health: id, ok, error; tiles: id, error, body."""
    t = tiles.select("id", (F.col("error").isNull() & (F.length("body") > 0)).alias("tile_ok"), F.col("error").alias("tile_error"), F.length("body").alias("tile_bytes"))
    return health.join(t, "id", "full").select("id", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("tile_ok", F.lit(False)).alias("tile_ok"), "error", "tile_error", "tile_bytes")
