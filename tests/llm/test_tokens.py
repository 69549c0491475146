import hashlib

import numpy as np
import pytest

from mapweave.llm.bpe_codec import codec, encode_decode
from mapweave.llm.common import tokenizer, tokenizer_path
from mapweave.llm.token_counts import _counter, count_tokens, proven_whole

ODD = [
    None, "", " ", "plain words", " a  b\n\n  x  y \x1c\x1d z\x85w", "A<|endoftext|>B <|startoftext|> C<|endoftext|>", "İstanbul ΣΑΣ ÀÉ é ﬁ", "don't I'LL we'Ve 12345 ½ ² ٣", "\0 hi", "日本語 テキスト 😀😀",
    "a" * 5000, " " * 3000 + "x", "​﻿ q", "Dž Å Ω K", "<|ENDOFTEXT|> <|endoftext|", "ß ẞ ŉ", "word " * 40_000, "\t\r\n\x0b\x0c", "x y z　w", "naïve Straße œuvre", "!!!???...;;;", "_a_b__c 9a9",
]


def frame(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(1, "repeated row", 1), (1, "repeated row", 1), (None, "null key", 1)], "doc_id long, text string, n_tokens long")


def library(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_counts_are_those_of_the_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = frame(spark).collect()
    got = sorted(map(str, count_tokens(frame(spark)).collect()))
    want = []
    for r in rows:
        n = len(library(path, r.text))
        want.append(f"Row(doc_id={r.doc_id}, n_bytes={len((r.text or '').encode())}, n_tokens={n}, over_limit={n > 512})")
    assert got == sorted(want)
    assert count_tokens(frame(spark).limit(0)).count() == 0


def test_proven_strings_are_one_token():
    path = tokenizer_path("byte_bpe_50k.json")
    whole = proven_whole(path)
    some = [w for w in list(whole)[::997] if w.strip()]
    assert len(whole) > 49_000 and all(len(library(path, w)) == 1 for w in some)


def test_codec_is_that_of_the_library(spark):
    path = tokenizer_path("word_bpe_49k.json")
    tok = tokenizer(path)
    for r in encode_decode(frame(spark), keep_ids=True).collect():
        text = ODD[r.doc_id] if r.doc_id not in (1, None) else None
        if text is None and r.decoded:
            continue  # the rows that share key 1, and the null key
        ids = library(path, text)
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == decoded and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["documents", "conversations"])
def test_codec_on_a_table(name):
    import duckdb

    path = tokenizer_path("word_bpe_49k.json")
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '/root/testdata/sf0.01/{name}.parquet'").fetchall()]
    k = codec(path)
    for text, (ids, _) in zip(texts, k.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library(path, text)
    assert k.speculated and k.merged


def test_pairs_are_what_merging_leaves():
    """The vectorised test against merging each pair of neighbours alone."""
    k = codec(tokenizer_path("word_bpe_49k.json"))
    r = np.random.default_rng(1)
    inner = np.array([i for t, i in k.whole.items() if not t.endswith("</w>")])
    last = np.array([i for t, i in k.whole.items() if t.endswith("</w>")])
    a, b = r.choice(inner, 3000), r.choice(last, 3000)
    good = k.pairs(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        spelt = k.names[x] + k.names[y].removesuffix("</w>")
        assert ([t.id for t in k.tok.model.tokenize(spelt)] == [x, y]) == g


def every_code_point():
    """A text for each, beside letters, digits, white space, an apostrophe and combining marks."""
    for c in map(chr, (k for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000)):
        yield f"A{c}b {c} 1{c}2  {c}{c}'s !{c}? e{c}́ aͅ{c}"


def test_every_code_point_is_taken_as_the_library_takes_it():
    texts = list(every_code_point())
    path = tokenizer_path("byte_bpe_50k.json")
    count = _counter(path)[0]
    own = codec(tokenizer_path("word_bpe_49k.json"))
    other = tokenizer(tokenizer_path("word_bpe_49k.json"))
    for k in range(0, len(texts), 20_000):
        some = texts[k : k + 20_000]
        want = [len(x.ids) for x in tokenizer(path).encode_batch(some, add_special_tokens=False)]
        assert [hex(k + i) for i, t in enumerate(some) if count(t) != want[i]] == []
        want = [np.array(x.ids, "<u4").tobytes() for x in other.encode_batch(some, add_special_tokens=False)]
        got = own.encode_batch(some)
        assert [hex(k + i) for i in range(len(some)) if got[i][0] != want[i]] == []
