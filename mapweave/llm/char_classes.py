"""Classes of characters as a tokenizer's own pre-tokenizer has them, whatever Unicode version it was built with.

Patterns run in the regex module, whose Unicode version is another one. Every character outside ASCII that a worker meets is put to
the library once; a text with one that the two take differently is searched in a copy in which such characters are replaced
by one of their class, and the pieces are cut from the text itself.
"""

from __future__ import annotations

import regex

from mapweave.llm.common import WHITE_SPACE

#: A character of each class on which all versions agree.
LETTER, NUMBER, SPACE, OTHER = "é", "²", "\xa0", "¡"


class Finder:
    """Finds the pieces of texts by a pattern of letters, numbers, white space and others.

    cut: the library's pre-tokenizer. runs: whether it keeps neighbouring numbers together.
    """

    def __init__(self, pattern: regex.Pattern, cut, runs: bool):
        self.pattern, self.cut, self.runs = pattern, cut, runs
        self.agree: set[str] = set()
        self.masks: dict[int, str] = {}
        self.own = regex.compile(rf"(\p{{L}})|(\p{{N}})|([{WHITE_SPACE}])")

    def _pieces(self, text: str) -> int:
        return len(self.cut.pre_tokenize_str(text))

    def _class(self, c: str) -> str:
        """What the library takes c for."""
        if self._pieces("a" + c) == 1 and self._pieces("!" + c) > 1:
            return LETTER
        if self._pieces("!" + c) == 1 and self._pieces("!" + c + "!") == 1:
            return OTHER
        if self.runs:
            return NUMBER if self._pieces("1" + c) == 1 else SPACE
        return NUMBER if self._pieces(c) else SPACE

    def _learn(self, c: str) -> bool:
        met = self.own.fullmatch(c)
        if ord(c) < 128 or self._class(c) == (OTHER if met is None else (LETTER, NUMBER, SPACE)[met.lastindex - 1]):
            self.agree.add(c)
            return True
        self.masks[ord(c)] = self._class(c)
        return False

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not [c for c in set(text) - self.agree if ord(c) in self.masks or not self._learn(c)]:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.masks))]


class Normaliser:
    """Composition and lower case as the library's normaliser has them; by Python's own tables where both are known to agree."""

    #: Marks of the lowest and highest order, and ordinary ones: beside them an order or a composition that differs shows.
    BESIDE = ("{}", "a{}", "{}́", "{}̴", "aͅ{}", "á{}", "a{}̣")

    def __init__(self, normalizer, plain):
        self.normalizer, self.plain = normalizer, plain
        self.safe: set[str] = set()

    def _learn(self, c: str) -> bool:
        """Beyond the basic plane pairs compose that single characters don't show, so those texts all go to the library."""
        if ord(c) < 128 or (ord(c) < 0x10000 and all(self.normalizer.normalize_str(b.format(c)) == self.plain(b.format(c)) for b in self.BESIDE)):
            self.safe.add(c)
            return True
        return False

    def __call__(self, text: str) -> str:
        if text.isascii() or all(self._learn(c) for c in set(text) - self.safe):
            return self.plain(text)
        return self.normalizer.normalize_str(text)
