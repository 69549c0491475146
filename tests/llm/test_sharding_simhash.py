import random
import zlib

import numpy as np
import pytest
import xxhash

from mapweave.llm.sharding import shard
from mapweave.llm import blocks, set_join, simhash
from mapweave.llm.pivots import coordinates, packed, unpacked
from mapweave.llm.simhash import bucket_links, fingerprint, near_duplicates, similar_classes

SCHEMA = "doc_id long, text string, size string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            t = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            out.append((i, " ".join(t)))
        else:
            out.append((i, " ".join(r.choice(words) for _ in range(r.randrange(1, 300)))))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, out[0][1]), (n + 3, out[0][1]), (n + 4, "Long " * 50000)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_majority():
    for _, t in corpus(2, 60):
        assert fingerprint(t) == plain_fingerprint(t)
    assert fingerprint("ÀB c d") == plain_fingerprint("ÀB c d")


@pytest.mark.parametrize(("bits", "block"), [(4, simhash.BLOCK), (4, 2), (0, simhash.BLOCK), (9, simhash.BLOCK)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, bits, block):
    """Also with buckets cut into blocks of two, at which every pair must still meet."""
    monkeypatch.setattr(blocks, "PART", 1)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = corpus()
    got = near_duplicates(docs(spark, rows), bits=bits).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    low = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= bits and low[j] < low[i]:
                    low[i], changed = low[j], True
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", low[i]) for i, _ in rows)


def test_large_bucket_is_walked():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 64, 6, dtype=np.uint64)
    fp = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in r.choice(40, r.integers(0, 4), replace=False))) for b in base for _ in range(60)], np.uint64))
    table = coordinates(fp[:, None], simhash.PIVOTS)
    assert (unpacked(packed(table)) == table).all()
    order = np.argsort(packed(table))
    fp, table = fp[order], table[order]
    a, b = bucket_links(np.zeros(len(fp), int), fp, fp[:, None], table, 4)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    name = dict(zip(a.tolist(), b.tolist(), strict=True))
    root = [name.get(int(f), int(f)) for f in fp]
    for i in range(len(fp)):
        for j in range(len(fp)):
            assert (root[i] == root[j]) == bool(reach[i, j])


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    assert shard(docs(spark, [])).count() == 0


@pytest.mark.parametrize("piece_rows", [50_000, 5])
def test_shards(spark, piece_rows):
    rows = corpus(4, 3000) + [(9000 + i, "one hot text " * 20) for i in range(1500)]
    got = [r.asDict() for r in shard(docs(spark, rows), piece_rows=piece_rows).collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total = sum(r["size"] for r in got)
    largest = max(r["size"] for r in got)
    for s in range(24):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if not any(r["size"] == largest for r in own):
            assert abs(sum(r["size"] for r in own) - total / 24) <= max(2500, 0.01 * total / 24) + largest * any(r["size"] == largest for r in got) * 0.6
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_equal_texts_stay_in_one_shard(spark):
    """Groups up to a hundredth of a shard, whatever the boundaries."""
    r = random.Random(8)
    rows = [(i, f"text {r.randrange(2500)} " * r.randrange(1, 4)) for i in range(12_000)]
    got = shard(docs(spark, rows)).groupBy("text_crc32").agg({"shard": "min", "size": "sum"}).join(shard(docs(spark, rows)).groupBy("text_crc32").agg({"shard": "max"}), "text_crc32").collect()
    whole = 0.01 * sum(x["sum(size)"] for x in got) / 24
    small = [x for x in got if x["sum(size)"] <= whole]
    assert len(small) > 1000 and all(x["min(shard)"] == x["max(shard)"] for x in small)


def test_one_row_and_hot_key(spark):
    assert [(r.shard is not None, r.slot) for r in shard(docs(spark, [(1, "a")])).collect()] == [(True, 0)]
    got = shard(docs(spark, [(7, "same") for _ in range(480)])).collect()
    counts = {s: sum(r.shard == s for r in got) for s in range(24)}
    assert set(counts.values()) == {20}


def test_similar_texts_are_found(spark):
    """Links of at least 0.8, and no texts of under 0.6 in one class that are not joined by others."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(150):
        base = [r.choice(words) for _ in range(r.randrange(60, 400))]
        for _ in range(r.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {x.doc_id: x.component_id for x in similar_classes(docs(spark, rows)).collect()}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 50 and sum(root[i] == root[j] for i, j in near) >= 0.95 * len(near)
    assert not [1 for i in sets for j in sets if i < j and root[i] == root[j] and not sets[i] & sets[j]]


def test_a_line_repeated_within_texts_links_nothing_else(spark):
    """Wholly different words but one line that each text repeats: sets of shingles that share a hundredth."""
    r = random.Random(5)
    line = " ".join(f"line{i}" for i in range(11))

    def text(i):
        own = [f"t{i}w{r.randrange(4000)}" for _ in range(400)]
        return " ".join(" ".join(own[k : k + 16]) + " " + line for k in range(0, 400, 16))

    got = similar_classes(docs(spark, [(i, text(i)) for i in range(12)])).collect()
    assert sorted(x.component_id for x in got) == list(range(12))


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def exact_classes(sets):
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sets:
        for j in sets:
            same = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or (same and same >= 0.8 * len(sets[i] | sets[j]) - 1e-9)):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in sets}


def changed(r, words, similarity):
    """Words with a run of new ones, so that the sets of shingles have about that similarity."""
    run = max(1, round(len(words) * (1 - similarity) / (1 + similarity)) - 4)
    k = r.randrange(len(words) - run)
    return [*words[:k], *[f"new{r.random()}" for _ in range(run)], *words[k + run :]]


def test_bits_asked_for_have_a_range():
    for bits in (-1, 13):
        with pytest.raises(ValueError, match="differing bits"):
            simhash.masks(bits)


def test_limits_of_fingerprints_hold():
    """Distances of pairs at the similarity stay within the limits, by far."""
    r = random.Random(2)
    for n, limit in ((5, set_join.bits_of(0.8, set_join.FEW_SHARE)), (18, set_join.bits_of(0.8, set_join.FEW_SHARE)), (36, set_join.bits_of(0.8)), (360, set_join.bits_of(0.8))):
        far = []
        for _ in range(300):
            whole = [f"s{r.random()}" for _ in range(n)]
            a, b = (set_join.majority(set_join.digests_of(" ".join(x), 1)) for x in (whole, whole[: round(n * 0.8)]))
            far.append(int(np.bitwise_count(a ^ b).sum()))
        assert max(far) <= limit and np.mean(far) < 0.7 * limit


@pytest.mark.parametrize("block", [8192, 4])
def test_classes_are_those_of_the_verified_pairs(spark, monkeypatch, block):
    """Pairs on both sides of 0.8, most of them between 0.7 and 0.85, and a group of copies that share a passage; also with buckets in blocks of four."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(blocks, "PART", 1)
    r = random.Random(11)
    rows = []
    for similarity in [0.65, 0.7, 0.72, 0.74, 0.76, 0.78, 0.79, 0.8, 0.81, 0.82, 0.83, 0.85, 0.9] * 8:
        base = [f"w{r.randrange(9000)}" for _ in range(r.randrange(80, 400))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(r, base, similarity)))]
    hot = [f"h{i}" for i in range(200)]
    for _ in range(60):
        rows.append((len(rows), " ".join(changed(r, hot, r.choice([0.78, 0.9, 0.95])))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "A  b", "a b c"])]
    sets = plain_sets(rows)
    got = {x.doc_id: x.component_id for x in similar_classes(docs(spark, rows)).collect()}
    assert got == exact_classes(sets)


def test_no_pair_of_just_the_similarity_is_lost(spark):
    r = random.Random(17)
    rows, pairs = [], 0
    while pairs < 120:
        base = [f"p{pairs}w{r.randrange(900)}" for _ in range(r.randrange(60, 300))]
        two = [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(changed(r, base, r.uniform(0.8, 0.83))))]
        a, b = plain_sets(two).values()
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows, pairs = rows + two, pairs + 1
    got = similar_classes(docs(spark, rows)).collect()
    assert all(x.component_id == x.doc_id // 2 * 2 for x in got)
