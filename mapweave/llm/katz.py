"""Katz backoff language model of words, counted and applied over a whole corpus.

P(w | h) = d(c) c(h w) / c(h) for runs of words seen in training, else a(h) P(w | h'), where h' is the history h without its first word; P(w) =
d(c) c(w) / N for words seen in training and the rest of the mass for the one event of an unseen word. A history that training
lacks gives way to h' as it is. The discounts d are Good-Turing's up to a count of 5, for each order its own. The backoff weight
a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of their P(w | h')) makes every history sum to one exactly. A text is
scored from a start through its words to one end token; its first word has the start alone as history.

Nothing here holds the vocabulary. Texts become chunks of word numbers, written once to the shared folder. Each chunk asks
for the words, then for the pairs, then for the longer runs it has (each once, sorted, as compressed arrays); the tables of counts
are made in partitions by hash of the word, or of the run's history, which answer each chunk in its own order; the chunk then
evaluates the recursion token by token. So a frequent word costs one entry a chunk. Runs after a very frequent history are dealt
out over several partitions, whose sums for the history are added up (a few rows for each partition). Histories of two words are named by
both numbers (exactly, below 2**32 words), longer ones by 64-bit hashes.

To the driver come a few sums, and those of spread histories. Counts have 64 bits (the arrays compress); those within a chunk have 32. Words are known by
64-bit hashes. Null and empty texts are the end token alone;
repeated rows are counted and scored as often as they occur; without training rows every word is unseen (base and
score 0); an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import doc_columns, drop_written, map_arrow, whole_groups, written
from mapweave.llm.common import release as release_path
from mapweave.llm.fm_classifier import remainder

#: Tokens to a chunk; words, and tokens whose pairs or longer runs go, to a partition.
CHUNK, WORDS, PAIRS, RUNS = 1_800_000, 1_000_000, 1_800_000, 1_500_000
#: Longest run of words that is counted.
ORDER = 3
#: Counts up to which Good-Turing discounts.
LOW = 5
#: What no text has as a word: the end token.
END = b"\n"
NONE, START = np.uint64((1 << 63) + 1), np.uint64((1 << 63) + 2)


#: Columns of a chunk that its evaluation needs; what it was told stands in the first of them, in rows of other kinds.
PARTS_OF_CHUNK = ["ids", "nulls", "sizes", "held", "tokens", "place"]


@cache
def _codec() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """An array as bytes: its length, then each byte place that is not all zero, compressed by itself."""
    places = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    used = [k for k, x in enumerate(places) if x.any()]
    parts = [_codec()[0].compress(places[k].tobytes()) for k in used]
    return struct.pack(f"<QB{len(used)}Q", len(a), sum(1 << k for k in used), *map(len, parts)) + b"".join(parts)


def release(b: bytes, kind: type) -> np.ndarray:
    n, mask = struct.unpack_from("<QB", b)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    used = [k for k in range(8) if mask >> k & 1]
    at = 9 + 8 * len(used)
    for k, size in zip(used, struct.unpack_from(f"<{len(used)}Q", b, 9), strict=True):
        out[:, k] = np.frombuffer(_codec()[1].decompress(b[at : at + size]), np.uint8)
        at += size
    return out.view(kind).ravel()


def squeeze_names(a: np.ndarray) -> bytes:
    """Ordered 64-bit names: steps of their upper halves, and of their lower ones while the upper one stays."""
    high, low = (a >> np.uint64(32)).astype(np.uint32), a.astype(np.uint32)
    up = np.diff(high, prepend=np.uint32(0))
    return squeeze(np.concatenate([up, np.where(up == 0, np.diff(low, prepend=np.uint32(0)), low)]))


def release_names(b: bytes) -> np.ndarray:
    both = release(b, np.uint32)
    up, low = np.split(both, 2)
    sums = np.cumsum(low, dtype=np.uint32)  # modulo 2**32, as the steps are
    heads = np.flatnonzero(np.append(True, up[1:] != 0))
    sums -= np.repeat(sums[heads] - low[heads], np.diff(np.append(heads, len(low))))
    return (np.cumsum(up, dtype=np.uint64) << np.uint64(32)) | sums


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def mixed(a: np.ndarray, seed: int = 0) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = a + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts for counts 0 to LOW (0 is not used) from the numbers of items that occur 1 to LOW + 1 times.

    Katz's form is used up to the largest count for which all its discounts lie between 0 and 1. Where there is none (no item
    occurs once or twice, or more occur twice than half of those that occur once), an absolute discount is taken instead: n1 / (n1 + 2 n2) of an occurrence.
    """
    for k in range(LOW, 0, -1):
        if min(n[: k + 1]) <= 0:
            continue
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1, *d, *[1] * (LOW - k)])
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([1, *[(r - cut * 0.999) / r for r in range(1, LOW + 1)]])


@dataclass
class Unigrams:
    """tokens, types: of training. P(word) by its count; count 0 is the unseen word."""

    tokens: int
    types: int
    discount: np.ndarray
    unseen: float

    @staticmethod
    def of(tokens: int, types: int, n: list[int]) -> Unigrams:
        if not tokens:
            return Unigrams(0, 0, np.ones(LOW + 1), 1.0)
        d = good_turing(n)
        left = sum(n[r - 1] * r * (1 - d[r]) for r in range(1, LOW + 1))
        if left <= 0:  # no rare word: one more token, unseen
            return Unigrams(tokens + 1, types, np.ones(LOW + 1), 1 / (tokens + 1))
        return Unigrams(tokens, types, d, left / tokens)

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(float)
        return np.where(count > 0, self.discount[np.minimum(count, LOW)] ** (count <= LOW) * c / max(self.tokens, 1), self.unseen)


def chunks(docs: DataFrame, key: str, text: str, by: int, held_out: int) -> DataFrame:
    """Two rows for each chunk: its documents and their tokens as numbers of words (kind text), and the hashes and training counts of its words (kind words)."""
    rows = doc_columns(docs, key, text).withColumn("held", F.coalesce(remainder("doc_id", by) == held_out, F.lit(False)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        names = ["kind", "chunk", "words", "docs", *PARTS_OF_CHUNK, "vocab", "counts"]

        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(self)
                return n

        def fresh():
            return Index(), array("I"), [], [], []

        index, tokens, ids, sizes, held = fresh()
        made = 0

        def row() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            vocab, place = np.unique(hashes, return_inverse=True)
            t = np.frombuffer(tokens, np.uint32)
            train = ~np.repeat(np.array(held, bool), sizes)
            counts = np.bincount(place[t[train]], minlength=len(vocab)).astype(np.uint32)
            known = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8)
            parts = [squeeze(known[0]), squeeze(known[1]), squeeze(np.array(sizes, np.uint32)), squeeze(np.array(held, np.uint8)), squeeze(t), squeeze(place.astype(np.uint32))]
            asked = [squeeze(_steps(vocab)), squeeze(counts)]
            kinds = [pa.string()] + [pa.int64()] * 3 + [pa.binary()] * 8
            rows = [("text", first + made, len(vocab), len(ids), *parts, None, None), ("words", first + made, len(vocab), len(ids), *[None] * 6, *asked)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc, value, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_buffer()
                found = [] if raw is None else raw.to_pybytes().lower().split()
                tokens.extend(map(index.__getitem__, found))
                tokens.append(index[END])
                ids.append(doc)
                sizes.append(len(found) + 1)
                held.append(out)
                if len(tokens) >= CHUNK:
                    yield row()
                    made += 1
                    index, tokens, ids, sizes, held = fresh()
        if ids:
            yield row()

    return rows.mapInArrow(each, "kind string, chunk long, words long, docs long, " + ", ".join(f"{c} binary" for c in [*PARTS_OF_CHUNK, "vocab", "counts"]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of each value of the first column, one value at a time."""
    for columns in whole_groups(batches, 1):
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        yield from (list(x) for x in zip(*(np.split(c, cuts) for c in columns), strict=True))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


ASKED_WORDS = "p long, chunk long, vocab binary, counts binary"
TOLD_WORDS = "chunk long, p long, number binary, count binary, sums array<long>"


def count_words(table: DataFrame, bits: int) -> DataFrame:
    """For each chunk and part p of the hash range: numbers and counts of its words there; and a row of sums for each p.

    Numbers start from 1 in each p with the most frequent word, so that most entries are small; 0 stands for words that training lacks.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocab, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, c = np.cumsum(release(vocab, np.uint64), dtype=np.uint64), release(counts, np.uint32)
                part = (h >> np.uint64(64 - bits)) if bits else np.zeros(len(h), np.uint64)
                cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
                rows = [(int(p[0]), chunk, squeeze(_steps(x)), squeeze(y)) for p, x, y in zip(np.split(part, cuts), np.split(h, cuts), np.split(c, cuts), strict=True)]
                yield _batch(rows, ASKED_WORDS)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, chunk, vocab, counts in _groups(batches):
            asked = [np.cumsum(release(v, np.uint64), dtype=np.uint64) for v in vocab]
            words, at = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(at, np.concatenate([release(c, np.uint32) for c in counts]), len(words)).astype(np.int64)
            known = total > 0
            number = np.where(known, np.argsort(np.argsort(-total, kind="stable"), kind="stable") + 1, 0)
            few = np.bincount(np.minimum(total, LOW + 2), minlength=LOW + 3)[1 : LOW + 2]
            yield _batch([(-1, int(p[0]), None, None, [int(total.sum()), int(known.sum()), *few.tolist()])], TOLD_WORDS)
            ends = np.cumsum([len(a) for a in asked])[:-1]
            for c, own in zip(chunk, np.split(at, ends), strict=True):
                yield _batch([(int(c), int(p[0]), squeeze(number[own].astype(np.uint32)), squeeze(total[own]), None)], TOLD_WORDS)

    asked = table.select("chunk", "vocab", "counts").mapInArrow(ask, ASKED_WORDS)
    return asked.repartition("p").sortWithinPartitions("p", "chunk").mapInArrow(tell, TOLD_WORDS)


@dataclass
class Grams:
    """The distinct runs of one length in a chunk: `at` gives each token's, the rest stands in the order of the runs.

    known: whether training has the history; weight: how often. n: how often the chunk's training texts have the run. lower: how often
    training has the run without its first word, of `under` with that history; backed: its probability.
    """

    at: np.ndarray
    history: np.ndarray
    known: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    n: np.ndarray
    lower: np.ndarray
    under: np.ndarray | None
    backed: np.ndarray

    def dealt(self, parts: int, hot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each partition: the places of its runs, ordered by history, and which histories are spread. Stable sorts, so that every machine gets the same order."""
        at = np.flatnonzero(self.known)
        a, b, weight = self.history[at], self.word[at], self.weight[at]
        spread = weight > hot
        salt = np.where(spread, mixed(b, 1) % np.maximum(-(-weight // max(hot, 1)), 1).astype(np.uint64), np.uint64(0))
        part = (mixed(a) + salt) % np.uint64(parts)
        order = np.argsort(a, kind="stable")
        part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint64)[order]  # short numbers are sorted by radix
        by_part = np.argsort(part, kind="stable")
        order, part = order[by_part], part[by_part]
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for own, p, s in zip(np.split(at[order], cuts), np.split(part, cuts), np.split(spread[order], cuts), strict=True):
            if len(own):
                yield int(p[0]), own, s


@dataclass
class Level:
    """What is known of the runs of one length: partitions, the weight beyond which a history is spread, and, once counted, discounts and sums of spread histories."""

    parts: int
    hot: int
    discount: np.ndarray | None = None
    wide: dict[int, tuple[np.ndarray, float]] | None = None


@dataclass
class Model:
    """word_parts: partitions of words, among which their numbers take turns; most: what numbers stay below."""

    word_parts: int
    most: int
    docs: int
    unigrams: Unigrams
    levels: list[Level]


class Chunk:
    """A chunk with what it was told about its words."""

    def __init__(self, row: dict, told: list[tuple[int, bytes, bytes]], model: Model):
        self.model = model
        place = release(row["place"], np.uint32)
        self.tokens = place[release(row["tokens"], np.uint32)]
        self.sizes = release(row["sizes"], np.uint32).astype(np.int64)
        self.held = release(row["held"], np.uint8).astype(bool)
        self.ids = pa.array(release(row["ids"], np.int64), mask=release(row["nulls"], np.uint8).astype(bool))
        number, count = [], []
        for p, n, c in sorted(told):
            n = release(n, np.uint32).astype(np.uint64)
            number.append(np.where(n > 0, (n - np.uint64(1)) * np.uint64(model.word_parts) + np.uint64(p), NONE))
            count.append(release(c, np.int64))
        self.number = np.append(np.concatenate(number), START)  # the last place is the start
        self.count = np.append(np.concatenate(count), 0).astype(np.int64)
        if len(self.number) != int(place.max()) + 2:
            raise ValueError("a chunk was not told about all of its words")
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _distinct(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of a history (numbered for each token) and the token: the first token of each, each token's run, and how often training texts have each."""
        key = before * len(self.number)
        key += self.tokens
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        train = ~np.repeat(self.held, self.sizes)
        return first, at.astype(np.uint32), np.bincount(at[train], minlength=len(first)).astype(np.uint32)

    def pairs(self) -> Grams:
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.number) - 1
        first, at, n = self._distinct(before)
        history, word = before[first], self.tokens[first]
        name = self.number[history]
        weight = np.where(name == START, self.model.docs, self.count[history])
        return Grams(at, name, name != NONE, self.number[word], weight, n, self.count[word], None, self.model.unigrams.p(self.count)[word])

    def longer(self, g: Grams, n: np.ndarray, total: np.ndarray, chance: np.ndarray) -> Grams:
        """Runs of one word more than those of g, about which the counts, the counts of their histories and the probabilities are known."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = g.at[:-1]
        before[self.starts] = len(n)  # no history of this length
        first, at, own = self._distinct(before)
        history, low = before[first], g.at[first]
        there = history < len(n)
        history[~there] = 0
        weight = np.where(there, n[history], 0)
        a, b = g.history[history], g.word[history]
        if g.under is None and self.model.most < (1 << 32) - 1:
            name = (b << np.uint64(32)) | np.where(a == START, np.uint64((1 << 32) - 1), a)
        else:
            name = mixed(a ^ mixed(b, 2), 3)
        return Grams(at, name, weight > 0, self.number[self.tokens[first]], weight, own, n[low], total[low], chance[low])

    def climb(self, told: dict[int, dict[int, tuple]]) -> tuple[Grams, np.ndarray]:
        """The longest runs that all levels but the last have told about, or the last; and the probabilities of the last ones told."""
        g, chance = self.pairs(), None
        for k, level in enumerate(self.model.levels):
            if level.discount is None:
                return g, g.backed
            n, total, chance = heard(g, told.get(k, {}), level)
            if k + 1 < len(self.model.levels):
                g = self.longer(g, n, total, chance)
        return g, chance


def _heads(name: np.ndarray) -> np.ndarray:
    """Where, in ordered names, a new one begins."""
    return np.concatenate([[True], name[1:] != name[:-1]])


def heard(g: Grams, answers: dict[int, tuple], level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: how often training has it, and its history (with what is added for unseen ones), and its probability."""
    n, total, chance = np.zeros(len(g.word), np.int64), np.ones(len(g.word), np.int64), g.backed.copy()
    whole = np.append(level.discount, 1.0) == 1  # by the least count after a history: nothing is left for unseen words
    for q, own, spread in g.dealt(level.parts, level.hot):
        counts, totals, least, types, sums = answers[q]
        mine = release(counts, np.int64)
        name = g.history[own]
        head = _heads(name)
        of = np.cumsum(head) - 1
        of_all = release(totals, np.int64)
        of_all = np.maximum(of_all + whole[release(least, np.uint8)], 1)
        needs = np.bincount(of, mine == 0) > 0
        backoff = np.ones(len(of_all))
        if needs.any():
            backoff[needs] = Histories(release(types, np.int64).reshape(-1, LOW + 1), release(sums, np.float64), level.discount).backoff
        for k in np.flatnonzero(spread[head]):
            t, p = level.wide[int(name[head][k])]
            h = Histories(t[None, :], np.array([p]), level.discount)
            of_all[k], backoff[k] = h.total[0], h.backoff[0]
        n[own], total[own] = mine, of_all[of]
        seen = level.discount[np.minimum(mine, LOW)] ** (mine <= LOW) * mine / total[own]
        chance[own] = np.where(mine > 0, seen, backoff[of] * chance[own])
    return n, total, chance


ASKED_RUNS = "q long, chunk long, first binary, second binary, lower binary, under binary, n binary, spread binary"
TOLD_RUNS = "chunk long, q long, counts binary, totals binary, least binary, types binary, sums binary, few array<long>, wide array<long>"


def _joined(table: DataFrame, told: list[DataFrame], n_chunks: int) -> DataFrame:
    """All rows of a chunk together, its own row first."""
    all_ = table.select("chunk", F.lit(0).cast("long").alias("kind"), F.lit(-1).cast("long").alias("part"), *PARTS_OF_CHUNK)
    for kind, t in enumerate(told, 1):
        part, *blobs = [c for c in t.columns if c != "chunk"]
        names = PARTS_OF_CHUNK[: len(blobs)]
        all_ = all_.unionByName(t.select("chunk", F.lit(kind).cast("long").alias("kind"), F.col(part).alias("part"), *[F.col(b).alias(n) for b, n in zip(blobs, names, strict=True)]), allowMissingColumns=True)
    return all_.repartitionByRange(n_chunks, "chunk").sortWithinPartitions("chunk", "kind", "part")


def _read(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[int, Chunk, Grams, np.ndarray]]:
    """Each chunk, its runs that are to be asked for (the last ones, if all were told), and the probabilities of those told."""
    for chunk, kind, part, *blobs in _groups(batches):
        row = {name: b[0] for name, b in zip(PARTS_OF_CHUNK, blobs, strict=True)}
        words, told = [], {}
        for i in range(1, len(kind)):
            if kind[i] == 1:
                words.append((int(part[i]), *(b[i] for b in blobs[:2])))
            else:
                told.setdefault(int(kind[i]) - 2, {})[int(part[i])] = tuple(b[i] for b in blobs[:5])
        c = Chunk(row, words, model)
        yield int(chunk[0]), c, *c.climb(told)


def ask_runs(joined: DataFrame, model: Model) -> DataFrame:
    """What each chunk asks of each partition about the runs of the last level."""
    level = model.levels[-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, g, _ in _read(batches, model):
            for q, own, spread in g.dealt(level.parts, level.hot):
                under = None if g.under is None else squeeze(g.under[own])
                yield _batch([(q, number, squeeze_names(g.history[own]), squeeze(g.word[own]), squeeze(g.lower[own]), under, squeeze(g.n[own]), squeeze(spread.astype(np.uint8)))], ASKED_RUNS)

    return joined.mapInArrow(each, ASKED_RUNS)


def count_runs(asked: DataFrame, discount: np.ndarray, tokens: int) -> DataFrame:
    """For each chunk and partition: counts of its runs; for its histories the sum and the least of the counts after them, and, where the chunk has an
    unseen run, the numbers of runs by count and the sum of their lower probabilities (discount: of the lower order; tokens: what words are a part of).

    A row with chunk -1 has the numbers of runs that occur 1 to LOW + 1 times; one with chunk -2 the sums of spread histories.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, chunk, first, second, lower, under, n, spread in _groups(batches):
            asked = [release_names(x) for x in first]
            ends = np.cumsum([len(x) for x in asked])[:-1]
            a = np.concatenate(asked)
            del asked
            b = np.concatenate([release(x, np.uint64) for x in second])
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            run = np.empty(len(a), np.int64)
            run[order] = np.cumsum(new) - 1
            heads = order[new]
            total = np.bincount(run, np.concatenate([release(x, np.uint32) for x in n]), len(heads)).astype(np.int64)
            del b, order, new
            c = np.concatenate([release(x, np.int64) for x in lower])[heads]
            of_all = tokens if under[0] is None else np.concatenate([release(x, np.int64) for x in under])[heads]
            p_lower = np.where(total > 0, discount[np.minimum(c, LOW)] ** (c <= LOW) * c / of_all, 0.0)
            histories, of = np.unique(a[heads], return_inverse=True)
            # runs of count 1 to LOW, and the sum of larger counts
            types = np.stack([np.bincount(of[total == r], minlength=len(histories)) for r in range(1, LOW + 1)] + [np.bincount(of, np.where(total > LOW, total, 0), len(histories)).astype(np.int64)], axis=1)
            sums = np.bincount(of, p_lower, len(histories))
            after = types @ np.array([*range(1, LOW + 1), 1])
            least = np.where(after > 0, (types > 0).argmax(axis=1) + 1, 0).astype(np.uint8)
            few = np.bincount(np.minimum(total, LOW + 2), minlength=LOW + 3)[1 : LOW + 2]
            part = int(q[0])
            yield _batch([(-1, part, *[None] * 5, few.tolist(), None)], TOLD_RUNS)
            wide = np.unique(a[np.concatenate([release(x, np.uint8) for x in spread]).astype(bool)])
            if len(wide):
                k = np.searchsorted(histories, wide)
                yield _batch([(-2, part, None, None, None, squeeze(types[k].ravel()), squeeze(sums[k]), None, [int(x) - (1 << 63) for x in wide])], TOLD_RUNS)
            of_head = of[run]
            for c, own, mine in zip(chunk, np.split(run, ends), np.split(of_head, ends), strict=True):
                head = _heads(mine)
                k = mine[head]
                needs = k[np.bincount(np.cumsum(head) - 1, total[own] == 0) > 0]
                rare = (squeeze(types[needs].ravel()), squeeze(sums[needs])) if len(needs) else (None, None)
                yield _batch([(int(c), part, squeeze(total[own]), squeeze(after[k]), squeeze(least[k]), *rare, None, None)], TOLD_RUNS)

    return asked.repartition("q").sortWithinPartitions("q", "chunk").mapInArrow(each, TOLD_RUNS)


def spread_histories(told: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Sums of the histories that several partitions hold; about four for each partition at most, and the start."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for a, t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t, s = release(t, np.int64).reshape(-1, LOW + 1), release(s, np.float64)
            rows += [(int(x), *y.tolist(), z) for x, y, z in zip(a, t, s.tolist(), strict=True)]
        return _batch(rows, schema)

    types = [f"t{r}" for r in range(1, LOW + 2)]
    schema = ", ".join(["history long", *(f"{t} long" for t in types), "p double"])
    rows = map_arrow(told.filter("chunk = -2").select("wide", "types", "sums"), each, schema)
    summed = rows.groupBy("history").agg(*[F.sum(t).alias(t) for t in types], F.sum("p").alias("p")).collect()
    return {r["history"] + (1 << 63): (np.array([r[t] for t in types], np.int64), r["p"]) for r in summed}


class Histories:
    """Denominators and backoff weights from the types by count and the sum of lower probabilities of histories."""

    def __init__(self, types: np.ndarray, p: np.ndarray, discount: np.ndarray):
        r = np.arange(1, LOW + 1)
        total = types[:, :LOW] @ r + types[:, LOW]
        left = types[:, :LOW] @ (r * (1 - discount[1:]))
        none = left < 1e-9  # no rare run: one more occurrence, of an unseen one
        self.total = np.maximum(total + none, 1)
        left = np.where(none, 1.0, left) / self.total
        self.backoff = np.where(total > 0, left / np.maximum(1 - p, 1e-300), 1.0)


def score_chunks(joined: DataFrame, model: Model, n_tokens: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, g, chance in _read(batches, model):
            token = np.log10(np.maximum(chance, 1e-300))[g.at]
            plain = np.log10((c.count[:-1] + 1) / (n_tokens + model.unigrams.types + 1))[c.tokens]
            known = (c.count[c.tokens] > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    c.ids, pa.array(c.held), pa.array(c.sizes), pa.array(np.add.reduceat(known, c.starts)),
                    pa.array(np.full(len(c.sizes), n_tokens, np.int64)), pa.array(np.add.reduceat(plain, c.starts)), pa.array(np.add.reduceat(token, c.starts)),
                ], names=[x.split()[0] for x in schema.split(", ")],
            )

    return joined.mapInArrow(each, schema)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", by: int = 7, held_out: int = 2, order: int = ORDER) -> DataFrame:
    """A row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learns from rows whose key's crc32 modulo `by` is not held_out (null keys learn, too). order: words to the longest run, 2 at least.
    """
    if order < 2:
        raise ValueError("a model that backs off has runs of two words at least")
    spark = docs.sparkSession
    both = written(chunks(docs, key, text, by, held_out), "chunks", ["kind"])
    table, asked = (both.filter(F.col("kind") == k) for k in ("text", "words"))
    size = table.agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.sum("docs").alias("docs")).first()
    n_chunks, n_docs = max(size["chunks"], 1), size["docs"] or 0
    bits = max(0, ((size["words"] or 0) // WORDS).bit_length())
    words = written(count_words(asked, bits), "words")
    release_path(spark, f"{both.written_path}/kind=words")
    of_p = words.filter("chunk = -1").select([F.col("sums")[k].alias(f"s{k}") for k in range(LOW + 3)])
    *totals, most = of_p.agg(*[F.sum(f"s{k}") for k in range(LOW + 3)], F.max("s1")).first()
    n_tokens, n_types, *few = [x or 0 for x in totals]
    model = Model(1 << bits, (most or 0) << bits, n_docs, Unigrams.of(n_tokens, n_types, few), [])
    told = [words.filter("chunk >= 0").select("chunk", "p", "number", "count")]
    tables, discount = [both, words], model.unigrams.discount

    for length in range(2, order + 1):
        parts = max(1, -(-n_tokens // (PAIRS if length == 2 else RUNS)))
        level = Level(parts, max(10_000, n_tokens // (4 * parts)))
        model.levels.append(level)
        runs = written(count_runs(ask_runs(_joined(table, told, n_chunks), model), discount, max(model.unigrams.tokens, 1)), f"runs-{length}")
        few = runs.filter("chunk = -1").select(F.posexplode("few").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
        level.discount = discount = good_turing([next((x["n"] for x in few if x["r"] == r), 0) for r in range(LOW + 1)])
        level.wide = spread_histories(runs)
        told.append(runs.filter("chunk >= 0").select("chunk", "q", "counts", "totals", "least", "types", "sums"))
        tables.append(runs)
    out = written(score_chunks(_joined(table, told, n_chunks), model, n_tokens), "scores")
    for t in tables:
        drop_written(t)
    return out
