"""What tile serving learns from its answers, over logs of requests (batch) and as streams.

A log row is (seq, ts, layer_id, z, x, y, outcome ...); ts is event time and seq breaks ties. What earlier rows taught
counts for later ones only. In batch these are window frames; as streams they are keyed state with the same rules. The
watermark of the streams (late rows are dropped) is this engine's own choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mapweave.functions.mercator import area_key, block_key

#: Seconds that a failing layer is left alone; seconds in which a source counts as active; bytes under which a tile is blank, by its size.
FAILURE_TTL, ACTIVE, BLANK_BYTES = 60, 120, {256: 2500, 512: 9000}
WATERMARK = "10 minutes"


def _earlier(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def failing(log: DataFrame, failed: Column, ttl: int = FAILURE_TTL, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """log with is_failing: the layer's last failure before this row is ttl seconds old at most. A later failure restarts the clock.

    Time is cut into spans of ttl seconds, so that a busy layer's log is many groups: a row looks at its own span, and at the last
    failure of the one before.
    """
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(max(ttl, 1) * 1_000_000))
    cut = log.withColumn("__span", span).withColumn("__failed", F.when(failed, F.col("ts")))
    last = cut.filter("__failed IS NOT NULL").groupBy("layer_id", (F.col("__span") + 1).alias("__span")).agg(F.max("__failed").alias("__before"))
    own = F.max("__failed").over(_earlier(["layer_id", "__span"], list(order)))
    both = cut.join(last, ["layer_id", "__span"], "left").withColumn("__last", F.greatest(own, "__before"))
    return both.withColumn("is_failing", F.coalesce(F.col("ts") <= F.col("__last") + F.make_dt_interval(secs=F.lit(ttl)), F.lit(False))).select(*log.columns, "is_failing")


def blank_here(log: DataFrame, blank: Column, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """log with is_blank_here: an earlier answer was blank for this layer in the same block of four by four tiles."""
    keyed = log.withColumn("block", block_key(F.col("x"), F.col("y"), F.col("z")))
    return keyed.withColumn("is_blank_here", F.coalesce(F.max(blank).over(_earlier(["layer_id", "block"], list(order))), F.lit(False)))


def confirmed_here(log: DataFrame, served: Column, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """log with is_confirmed_here: an earlier answer had imagery for this layer in the same area (a tile of zoom 12)."""
    keyed = log.withColumn("area", area_key(F.col("x"), F.col("y"), F.col("z")))
    return keyed.withColumn("is_confirmed_here", F.coalesce(F.max(served).over(_earlier(["layer_id", "area"], list(order))), F.lit(False)))


def empty_areas(log: DataFrame, blank: Column, served: Column) -> DataFrame:
    """Areas (id, area) that were blank and never confirmed: they don't set the detail zoom."""
    keyed = log.withColumn("area", area_key(F.col("x"), F.col("y"), F.col("z")))
    seen = keyed.groupBy(F.col("layer_id").alias("id"), "area").agg(F.max(blank).alias("b"), F.max(served).alias("s"))
    return seen.filter(F.col("b") & ~F.coalesce("s", F.lit(False))).select("id", "area")


def last_used(log: DataFrame, served: Column, prefetch: Column | None = None) -> DataFrame:
    """When each layer last served. prefetch: rows that were asked for ahead of need; they put no source to use, so they are not credited."""
    credited = served if prefetch is None else served & ~F.coalesce(prefetch, F.lit(False))
    return log.filter(credited).groupBy("layer_id").agg(F.max("ts").alias("used_at"))


def active_sources(log: DataFrame, served: Column, now: Column, within: int = ACTIVE, layers: DataFrame | None = None, prefetch: Column | None = None) -> DataFrame:
    """Layers that served in the last seconds, the latest first; with layers only those of the catalogue."""
    out = last_used(log, served, prefetch).filter(now <= F.col("used_at") + F.make_dt_interval(secs=F.lit(within)))
    if layers is not None:
        out = out.join(layers.select(F.col("id").alias("layer_id")), "layer_id", "left_semi")
    return out.orderBy(F.col("used_at").desc(), "layer_id")


def shared_requests(log: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """Requests of a tile that follow each other within the gap share one fetch: z, x, y, begun, ended, callers."""
    session = F.session_window("ts", gap)
    return log.groupBy("z", "x", "y", session.alias("s")).agg(F.count("*").alias("callers")).select("z", "x", "y", F.col("s.start").alias("begun"), F.col("s.end").alias("ended"), "callers")


def shared_fetches(log: DataFrame, gap: str, left_at: Column) -> DataFrame:
    """The same with abandoned: every caller left (left_at, null if it stayed) before the fetch would have ended; abandoned_at: when the last one did."""
    told = log.withColumn("__left", left_at)
    grouped = told.groupBy("z", "x", "y", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("callers"), F.count("__left").alias("leavers"), F.max("__left").alias("last"))
    gone = (F.col("callers") == F.col("leavers")) & (F.col("last") < F.col("s.end"))
    return grouped.select("z", "x", "y", F.col("s.start").alias("begun"), F.col("s.end").alias("ended"), "callers", F.coalesce(gone, F.lit(False)).alias("abandoned"), F.when(gone, F.col("last")).alias("abandoned_at"))


def on_tile(served: DataFrame, told: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Tells a function of every micro-batch of served tiles, as a running query. options: of the stream's writer, such as checkpointLocation."""
    return served.writeStream.foreachBatch(told).options(**options).start()


def cache_keep(cache: DataFrame, limit: int = 1500, buckets: int = 64) -> DataFrame:
    """The newest `limit` entries (url, inserted_at) of a cache. Only what is newest in its bucket goes on to be compared with the rest, so no task sorts the whole cache."""
    newest = [F.col("inserted_at").desc(), "url"]
    own = Window.partitionBy(F.pmod(F.xxhash64("url"), F.lit(buckets))).orderBy(*newest)
    return cache.withColumn("__nth", F.row_number().over(own)).filter(F.col("__nth") <= limit).drop("__nth").orderBy(*newest).limit(limit)


ANSWER = "session string, seq long, z int, x long, y long, served_by string, asked array<string>"


def serve(requests: DataFrame, tile: int = 512, ttl: int = FAILURE_TTL, holes: bool = False) -> DataFrame:
    """Replays requests against recorded answers, learning as it goes: which layer serves each tile, and whom it asked.

    requests: session, seq, ts, z, x, y and answers, an array in candidate order of (layer_id, status, content_type, bytes,
    verdict). The last candidate is taken as it comes, unless holes may be left. What one answer teaches changes later
    ones, so a session's requests run one after the other, a row at a time; only what it has learnt is held, as a client does. 404 and
    204 are gaps; other errors and answers that are no image are failures; a verdict from the pixels goes before the
    number of bytes; ground with imagery before is trusted.
    """
    least = BLANK_BYTES.get(tile, 0)

    kinds = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("served_by", pa.string()), ("asked", pa.list_(pa.string()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session: object = object()  # what no session is called
        until: dict[str, float] = {}
        blank, confirmed, cache = set(), set(), set()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session"] != session:
                    session, until, blank, confirmed, cache = r["session"], {}, set(), set(), set()
                z, x, y, now = r["z"], r["x"], r["y"], r["ts"].timestamp()
                block = (z, x >> 2, y >> 2)
                area = (x << (12 - z), y << (12 - z)) if z <= 12 else (x >> (z - 12), y >> (z - 12))
                served, asked, answers = None, [], r["answers"] or []
                for i, a in enumerate(answers):
                    name, last = a["layer_id"], not holes and i == len(answers) - 1
                    if not last and (now <= until.get(name, float("-inf")) or (name, block) in blank):
                        continue
                    if (name, z, x, y) in cache:
                        served = name
                        break
                    asked.append(name)
                    if a["status"] in (404, 204):
                        blank.add((name, block))
                    elif not 200 <= (a["status"] or 0) < 300 or not (a["content_type"] or "").startswith("image/"):
                        until[name] = now + ttl
                    elif not last and (a["verdict"] == "empty" or (a["verdict"] is None and (name, area) not in confirmed and (a["bytes"] or 0) < least)):
                        blank.add((name, block))
                    else:
                        confirmed.add((name, area))
                        cache.add((name, z, x, y))
                        served = name
                        break
                out.append({"session": r["session"], "seq": r["seq"], "z": z, "x": x, "y": y, "served_by": served, "asked": asked})
            yield pa.RecordBatch.from_pylist(out, kinds)

    rows = requests.select("session", "seq", "ts", "z", "x", "y", "answers")
    return rows.repartition("session").sortWithinPartitions("session", "ts", "seq").mapInArrow(walk, ANSWER)


def with_holes(served: DataFrame) -> DataFrame:
    """Tiles that nothing served are drawn empty and not to be stored."""
    return served.withColumn("drawn", F.coalesce("served_by", F.lit("empty"))).withColumn("cache_control", F.when(F.col("served_by").isNull(), "no-store"))


class FailureMemory(StatefulProcessor):
    """For each layer the time until which it is left alone; forgotten when it has passed."""

    def __init__(self, ttl: int = FAILURE_TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until timestamp")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        held = self.until.get()
        until = held[0] if held else None
        out = []
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for r in pdf.itertuples(index=False):
            now = r.ts.to_pydatetime()
            if until is not None and now > until:
                until = None
            out.append((key[0], r.seq, r.ts, until is not None))
            if r.failed:
                until = now + pd.Timedelta(seconds=self.ttl).to_pytimedelta()
        if until is None:
            self.until.clear()
        else:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["layer_id", "seq", "ts", "is_failing"])

    def close(self) -> None:
        pass


#: The state store that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(log: DataFrame) -> DataFrame:
    """Event time with a zone, as watermarks need it."""
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def failing_stream(log: DataFrame, ttl: int = FAILURE_TTL) -> DataFrame:
    """A stream of (layer_id, seq, ts, failed) to (layer_id, seq, ts, is_failing); rows of a micro-batch are taken in order of time. Needs STATE_STORE."""
    return _timed(log).select("layer_id", "seq", "ts", "failed").groupBy("layer_id").transformWithStateInPandas(FailureMemory(ttl), "layer_id string, seq long, ts timestamp, is_failing boolean", "Append", "None")


def distinct_stream(log: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """A stream of requests with each tile asked once within the watermark."""
    return _timed(log).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["z", "x", "y"])


def usage_stream(log: DataFrame, every: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Serves and last use of each layer by window of event time."""
    counted = _timed(log).withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "layer_id").agg(F.count("*").alias("served"), F.max("ts").alias("used_at"))
    return counted.select(F.col("w.start").alias("begun"), "layer_id", "served", "used_at")


def blank_blocks_stream(log: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """A stream of log rows with `blank` to the blocks found blank, each told once within the watermark."""
    keyed = _timed(log).filter("blank").withColumn("block", block_key(F.col("x"), F.col("y"), F.col("z")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["layer_id", "block"]).select("layer_id", "block", "ts")
