"""A factorisation machine that scores documents for quality.

Features of a whole text: hashed words with their weight in the text, statistics of its structure (shares of symbols,
capitals, digits, repeated lines and words, ...), and metadata (its recorded length). Every pair of features interacts by
the product of their low-rank vectors; by the sum-of-squares identity all pairs are summed in time linear in the features:
    sum over i < j of <v_i, v_j> x_i x_j  =  half the sum over f of (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.

It is fitted on the driver by Adagrad on the features of TRAIN labelled rows at most (the least by hash of the key); the model
has a fixed size and is broadcast. However long these rows are, the driver holds a part of the table of their features at a time,
never all: they come a partition after the other and lie in a mapped file of its own. Scoring reads every text once and needs no shuffle.

Null and empty texts have no words and are scored by the rest; repeated rows and ties get equal scores; buckets that training
never met weigh nothing, so without labelled rows every score is exactly one half; words that share a bucket share
parameters; the score is a new column, others are kept.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import drop_written, written

#: Buckets of words, rank of the interactions, labelled rows used at most, passes over them.
BUCKETS, RANK, TRAIN, EPOCHS = 1 << 16, 8, 6_000, 8
#: Features of a batch that are scored at once.
FLAT = 500_000
#: Structure statistics, and one feature of metadata.
STATISTICS = 14
_KINDS = [b"#*$%&|<>", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"\n", bytes(range(128, 256))]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values. The statistics come first, then metadata, then words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, counts = len(words), Counter(words)
    size = max(len(raw), 1)
    dense = [(len(raw) - len(raw.translate(None, kind))) / size for kind in _KINDS]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dense += [
        min(sum(map(len, words)) / max(n, 1), 40) / 20, len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(n) / 10, len(lines) / max(n, 1), 1.0 if n < 20 else 0.0,
    ]
    dense.append(np.log1p(max(n_chars if n_chars is not None else len(text or ""), 0)) / 12)
    buckets = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % BUCKETS + len(dense)
    weight = np.fromiter(counts.values(), np.float64, len(counts))
    if n:
        weight /= np.sqrt(weight @ weight)
    return np.concatenate([np.arange(len(dense)), buckets]), np.concatenate([np.array(dense), weight])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * (total @ total - (v * v).sum()))

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The same for many rows at once, about FLAT features at a time."""
        out, k = [], 0
        sizes = np.cumsum([len(at) for at, _ in rows])
        while k < len(rows):
            to = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + FLAT, side="right")))
            at, x = (np.concatenate(c) for c in zip(*rows[k:to], strict=True))
            starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows[k : to - 1]])]).astype(np.int64)
            v = self.factors[at] * x[:, None]
            total = np.add.reduceat(v, starts)
            out.append(self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts)))
            k = to
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def in_parts(texts: pa.Array, sizes: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Features of a batch's rows, in lists of about FLAT features."""
    rows, held = [], 0
    for t, n in zip(texts, sizes, strict=True):
        rows.append(features(t.as_py(), n.as_py()))
        held += len(rows[-1][0])
        if held >= FLAT:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7, rate: float = 0.1, penalty: float = 1e-5) -> Model:
    """Logistic loss by Adagrad, a row at a time, in an order that the seed fixes."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + STATISTICS + 1
    w, v, b = np.zeros(n), rng.normal(0, 0.05, (n, RANK)), 0.0
    gw, gv, gb = np.full(n, 1e-2), np.full((n, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            va = v[at]
            vx = va * x[:, None]
            total = vx.sum(axis=0)
            m = b + w[at] @ x + 0.5 * (total @ total - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
            dw = g * x + penalty * w[at]
            dv = g * x[:, None] * (total[None, :] - vx) + penalty * va
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            np.add.at(gw, at, dw * dw)
            np.add.at(gv, at, dv * dv)
            np.add.at(w, at, -rate * dw / np.sqrt(gw[at]))
            np.add.at(v, at, -rate * dv / np.sqrt(gv[at]))
    met = np.zeros(n, bool)
    for at, _, _ in rows:
        met[at] = True
    v[~met] = 0  # else their random start would count
    return Model(float(b), w.astype(np.float32), v.astype(np.float32))


def remainder(key: str = "doc_id", by: int = 3) -> Column:
    """crc32 of the key as text, modulo `by`."""
    return F.pmod(F.crc32(F.col(key).cast("long").cast("string").cast("binary")), F.lit(by))


def _length(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("long") if name in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", most: int = TRAIN) -> Model:
    """Fits on rows whose key's remainder is not 1. A key with several labels counts with the lowest."""
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (remainder(key) != 1)).groupBy(F.col(key).cast("long").alias("k"))
        .agg(F.min(label).alias("y")).orderBy(F.xxhash64("k"), "k").limit(most).collect()
    )
    known = docs.sparkSession.createDataFrame([(r["k"], r["y"]) for r in chosen], "k long, y int")
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), _length(docs, n_chars).alias("n")).join(F.broadcast(known), "k").select("k", "y", "t", "n")

    def each(batches):
        for batch in batches:
            done = 0
            for part in in_parts(batch.column(2), batch.column(3)):
                keys = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array([at.astype("<i4").tobytes() for at, _ in part], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in part], pa.binary())], names=["k", "y", "at", "x"])

    # A key that stands for several rows (copies under one key) gives one of them, so the bound holds.
    rows = sample.mapInArrow(each, "k long, y int, at binary, x binary").groupBy("k").agg(F.min_by(F.struct("y", "at", "x"), F.xxhash64("at", "x")).alias("row")).select("k", "row.*")
    return fit_written(written(rows, "training-rows"))


def fit_written(rows: DataFrame) -> Model:
    """Fits on a written table (k, y, at, x), read a partition at a time; removes it."""
    known, end = [], 0
    with tempfile.TemporaryFile() as file:
        for r in rows.toLocalIterator():
            file.write(r["at"])
            file.write(r["x"])
            known.append((r["k"], end, len(r["at"]), r["y"]))
            end += 2 * len(r["at"])
        drop_written(rows)
        file.flush()
        held = np.memmap(file, np.uint8, "r").view(np.ndarray) if end else np.zeros(0, np.uint8)
        return fit([(held[i : i + n].view("<i4"), held[i + n : i + 2 * n].view("<f4"), y) for _, i, n, y in sorted(known)])


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars", into: str = "score") -> DataFrame:
    """docs with the score of every row in the column `into`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(held.value.scores(part) for part in in_parts(texts, sizes))]), pa.float64())

    return docs.withColumn(into, scored(F.col(text), _length(docs, n_chars)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, held_out, score, predicted) for each row of docs."""
    scored = score(docs, train(docs, labels, key, text), text, into="__score")
    return scored.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(remainder(key) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
