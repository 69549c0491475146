import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from mapweave.llm.common import tokenizer, tokenizer_path
from mapweave.llm.packing import cutting_stock, encode, pack

PATH = tokenizer_path("byte_bpe_50k.json")


def library(text):
    return [*tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, got, room=2048):
    """Every id of every row once, in gapless sequences within room. Returns the padding."""
    want = Counter()
    for i, t in rows:
        want[(i, len(library(t)))] += 1
    ids = {}
    for i, t in rows:
        ids.setdefault((i, len(library(t))), []).append(np.array(library(t), "<u4"))
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert any(zlib.crc32(a[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for a in ids[(p.doc_id, p.doc_tokens)])
        spans[(p.doc_id, p.doc_tokens)].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for k, n in want.items():
        assert Counter(x for s, m in spans[k] for x in range(s, s + m)) == {x: n for x in range(k[1])}
    padding = 0
    for pieces in sequences.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at and n > 0
            at += n
        assert at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_fast_ids_are_those_of_the_library():
    for t in ["", "plain words", " a  b\n\n c", "x<|endoftext|>y <|endoftext|", "é𝄞日本語 😀", "a" * 3000, " " * 3000, "\x1c\x85\xa0 z", "don't I'LL 123 ½"]:
        assert encode(PATH, t, 1).tolist() == library(t)


def test_packing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["one", "zweite", "trois", "quatro"]) for _ in range(r.choice([3, 40, 400, 900, 1500, 5000])))) for i in range(500)]
    rows += [(600, None), (601, ""), (None, "null key"), (602, "again"), (602, "again"), (602, "another text")] + [(700 + i, "hot " * 700) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    got = pack(docs).collect()
    padding = verify(rows, got)
    assert padding < 0.005 * sum(len(library(t)) for _, t in rows)


def test_small_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert verify([(1, "a b c")], pack(docs).collect()) == 0
    assert pack(docs.limit(0)).count() == 0


def test_cutting_stock_is_near_the_bound():
    r = np.random.default_rng(1)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(r.integers(1, 512, 40_000), return_counts=True), strict=True)}
    used, sequences = Counter(), 0
    for pattern, copies in cutting_stock(histogram, 512):
        assert sum(s * k for s, k in pattern.items()) <= 512
        sequences += copies
        for s, k in pattern.items():
            used[s] += k * copies
    assert all(used[s] <= histogram[s] for s in used)
    left = sum(s * (n - used[s]) for s, n in histogram.items())
    assert sequences + left / 512 <= 1.01 * sum(s * n for s, n in histogram.items()) / 512
