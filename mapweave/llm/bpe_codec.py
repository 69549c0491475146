"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A proposal is what the merges give if and only if every
token merges to itself and every two neighbours, merged alone, stay the same two tokens; so all neighbour pairs of a batch
are tested at once in NumPy, and only words with a failing pair undergo exact merging. Ids and spellings of words are then
joined to those of texts.

Classes of characters, lower case and composition are the library's own, whatever its Unicode version (char_classes.py).
Null texts encode as empty. Rows are independent: repeated rows, ties, extra columns and empty tables need no care.
Special strings inside texts become their own ids, as the library has it by default.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mapweave.llm.char_classes import Finder, Normaliser
from mapweave.llm.common import WHITE_SPACE, doc_columns, map_arrow, to_byte_chars, tokenizer, tokenizer_path

#: Distinct words and neighbour pairs that a worker remembers before it starts afresh.
WORDS, PAIRS = 250_000, 4_000_000


class PairTest:
    """Tells for neighbours (a, b), whether merging their joined symbols gives a and b again.

    Merges run in rank order, so the pair fails if some merge across the border would have come before the merges that
    built the two edges. The test undoes edges from the latest merge to the earliest and looks across at each step. All
    pairs take their steps together.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        built: dict[str, tuple[int, str, str]] = {}
        for rank, (x, y) in enumerate(merges):
            if x in vocab and y in vocab and x + y in vocab:
                built.setdefault(x + y, (rank, x, y))
        self.ids = np.full(max(vocab.values()) + 1, -1, np.int64)  # id -> place in merge order
        base = [t for t in vocab if t not in built]
        order = base + sorted(built, key=lambda t: built[t][0])
        place = {t: i for i, t in enumerate(order)}
        for t, i in place.items():
            self.ids[vocab[t]] = i
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        for t, (_, x, y) in built.items():
            self.left[place[t]], self.right[place[t]] = place[x], place[y]
        self.n = len(order)
        usable = [(x, y) for x, y in merges if x in place and y in place and x + y in place]
        keys = np.array([place[x] * self.n + place[y] for x, y in usable], np.int64)
        to = np.array([place[x + y] for x, y in usable], np.int64)
        sort = np.argsort(keys, kind="stable")
        self.keys, self.to = keys[sort], to[sort]
        self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], np.iinfo(np.int64).max)

    def fresh(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            bad = self.merge_of(a, b) < limit
            out[live[bad]] = False
            a, b, limit, live = a[~bad], b[~bad], limit[~bad], live[~bad]
            a2, b2 = self.right[a], self.left[b]
            a_whole, b_whole = a2 == a, b2 == b  # single symbols can't be undone
            undo_a = np.where(a_whole, False, b_whole | (a > b))
            done = a_whole & b_whole
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a2, a), np.where(undo_a, b, b2)
            keep = ~done
            a, b, limit, live = a[keep], b[keep], limit[keep], live[keep]
        return out

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.ones(0, bool)
        a, b = self.ids[first], self.ids[second]
        keys, back = np.unique(a * self.n + b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        seen = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        good = np.zeros(len(keys), bool)
        if seen.any():
            good[seen] = self.good[at[seen]]
        new = keys[~seen]
        if len(new):
            good[~seen] = self.fresh(new // self.n, new % self.n)
            if len(self.known) + len(new) > PAIRS:
                self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)
            known = np.concatenate([self.known, new])
            sort = np.argsort(known, kind="stable")
            self.known, self.good = known[sort], np.concatenate([self.good, good[~seen]])[sort]
        return good[back]


def _plain(text: str) -> str:
    """Composed and in lower case; white space is left, since words hold none."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Codec:
    """Encodes and decodes with a word-level BPE file (lower case, white space dropped, word ends marked)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.tok = tokenizer(path)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = PairTest(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # The word pattern of this family (contractions, words, single digits, symbols).
        words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
        self.words = Finder(words, self.tok.pre_tokenizer, runs=False)
        self.normalise = Normaliser(self.tok.normalizer, _plain)
        self.spell = to_byte_chars()
        self.ranks = dict(zip(self.pairs.keys.tolist(), self.pairs.to.tolist(), strict=True))
        self.whole = {t: i for t, i in self.vocab.items() if self._proven(t, i)}  # only these are proposed
        self.longest = max((len(t) - (len(self.end) if t.endswith(self.end) else 0) for t in self.whole), default=1)
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.speculated = self.merged = 0

    def _proven(self, t: str, i: int) -> bool:
        """The merges alone turn the symbols of t into t. At a word's end the library itself tells; inside a word plain merging does."""
        if self.end and t.endswith(self.end):
            return len(t) > len(self.end) and [x.id for x in self.tok.model.tokenize(t[: -len(self.end)])] == [i]
        if any(c not in self.vocab for c in t):
            return False
        n, parts = self.pairs.n, [int(self.pairs.ids[self.vocab[c]]) for c in t]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] * n + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                return False
            parts[k : k + 2] = [rank]
        return parts[0] == int(self.pairs.ids[i])

    def _propose(self, spelt: str) -> list[int] | None:
        whole, end, n, out, i = self.whole, self.end, len(spelt), [], 0
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                got = whole.get(spelt[i:j] + end if j == n else spelt[i:j])
                if got is not None:
                    out.append(got)
                    i = j
                    break
            else:
                return None
        return out

    def learn(self, words: list[str]) -> None:
        """Adds words to those whose ids are known."""
        spelt = [self.spell(w) for w in words]
        guess = [self._propose(s) for s in spelt]
        sizes = np.array([len(g) if g else 0 for g in guess], np.int64)
        flat = np.fromiter((t for g in guess if g for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        good = self.pairs(flat[inner], flat[inner + 1])
        failed = np.zeros(len(words), bool)
        failed[owner[inner[~good]]] = True
        names = self.names
        for k, w in enumerate(words):
            ids = guess[k]
            if ids is None or failed[k]:
                ids = [t.id for t in self.tok.model.tokenize(spelt[k])]
                self.merged += 1
            else:
                self.speculated += 1
            self.ids_of[w] = np.array(ids, "<u4").tobytes()
            self.text_of[w] = " ".join([names[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special strings stand as they are, marked by a leading NUL and white space, which no word holds."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(self.normalise(text))
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append("\0 " + part)
            else:
                out += self.words(self.normalise(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, for each text."""
        out: list[tuple[bytes, str]] = []
        at = 0
        while at < len(texts):
            if len(self.ids_of) > WORDS:
                self.ids_of.clear()
                self.text_of.clear()
            group, new, n = [], {}, 0
            while at < len(texts) and n < 2_000_000:  # characters whose words are looked at together
                got = self.pieces(texts[at])
                n += len(texts[at]) + 1
                group.append(got)
                new |= {w: None for w in got if w not in self.ids_of}
                at += 1
            for w in [w for w in new if w.startswith("\0 ")]:
                del new[w]
                self.ids_of[w] = np.array([self.special[w[2:]]], "<u4").tobytes()
                self.text_of[w] = w[2:]
            if new:
                self.learn(list(new))
            ids, names = self.ids_of.__getitem__, self.text_of.__getitem__
            for got in group:
                out.append((b"".join(map(ids, got)), " ".join(filter(None, map(names, got)))))
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, SHA-256 of the ids and of the decoded text; with keep_ids also ids (array) and decoded."""
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(path).encode_batch([x or "" for x in batch.column(1).to_pylist()])
        columns = [
            batch.column(0),
            pa.array([len(b) // 4 for b, _ in got], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b, _ in got]),
            pa.array([hashlib.sha256(s.encode("utf-8")).hexdigest() for _, s in got]),
        ]
        if keep_ids:
            columns += [pa.array([np.frombuffer(b, "<u4").astype("i4") for b, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got])]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(doc_columns(docs, key, text), each, schema)
