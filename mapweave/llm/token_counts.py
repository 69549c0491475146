"""Token counts by the whole-token shortcut.

Most words of a text are one token. Offline, every vocabulary string is put through the merges alone: those that come out
as one token are proven whole. A pre-token equal to a proven string counts 1 by a look-up; only the rest is merged, once
for each distinct pre-token that a worker meets (a bounded memory, emptied when full).

Classes of characters are the library's own, whatever its Unicode version (char_classes.py).
Null texts count as empty (0 bytes, 0 tokens). Rows are independent: repeated rows, ties and extra columns change nothing,
an empty table gives an empty result. Special strings inside texts are one token each, as the library has it by default.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mapweave.llm.char_classes import Finder
from mapweave.llm.common import WHITE_SPACE, byte_chars, doc_columns, map_arrow, to_byte_chars, tokenizer, tokenizer_path

#: The pre-token pattern of byte-level BPE (contractions, words, numbers, symbols, white space).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 300_000


def pre_token_pattern():
    ws = f"[{WHITE_SPACE}]"
    return regex.compile(PRE_TOKENS.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", ws))


class _Counts(dict):
    """Tokens of each pre-token; a missing one is merged and remembered."""

    def __init__(self, model, whole: dict[str, int]):
        super().__init__(whole)
        self.model, self.spell, self.whole = model, to_byte_chars(), whole

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(self.spell(piece)))
        self[piece] = n
        return n

    def trim(self) -> None:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(self.whole)


@cache
def proven_whole(path: str) -> dict[str, int]:
    """Every vocabulary string that the merges turn into exactly one token."""
    tok = tokenizer(path)
    code = {c: b for b, c in enumerate(byte_chars())}
    out = {}
    for piece in tok.get_vocab(with_added_tokens=False):
        if any(c not in code for c in piece):
            continue
        try:
            plain = bytes(code[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:
            continue  # a part of a character never is a pre-token
        if len(tok.model.tokenize(piece)) == 1:
            out[plain] = 1
    return out


@cache
def _counter(path: str):
    tok = tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    counts, find = _Counts(tok.model, proven_whole(path)), Finder(pre_token_pattern(), tok.pre_tokenizer, runs=True)
    look = counts.__getitem__

    def count(text: str | None) -> int:
        if not text:
            return 0
        n = 0
        if cut is not None and any(s in text for s in special):
            parts = cut.split(text)
            n, rest = len(parts) - 1, parts
        else:
            rest = (text,)
        for part in rest:
            n += sum(map(look, find(part)))
        return n

    return count, counts


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """A row (doc_id, n_bytes, n_tokens, over_limit) for each row of docs. path: a byte-level BPE file of the tokenizers library."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, counts = _counter(path)
        sizes, tokens = [], []
        for value in batch.column(1):
            raw = value.as_buffer()
            s = "" if raw is None else raw.to_pybytes().decode("utf-8", "replace")
            sizes.append(0 if raw is None else raw.size)
            tokens.append(count(s))
            counts.trim()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(doc_columns(docs, key, text), each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
