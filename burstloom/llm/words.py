"""Words of a text, as all operators of this subpackage see them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstloom.llm.consistent import INVISIBLE, TO_LATIN

#: a letter or digit, then letters, digits, combining marks and zero-width non-joiners
WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}\x{200C}]*"


def words(text: Column) -> Column:
    """The words of a consistent text in order, in lower case; null gives null, no word an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _class(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_SETTLED = "\x00-\x7f«»،؛؟\u0621-\u063a\u0641-\u064a\u0660-\u0669پچژکگی۰-۹\u200c\u2010-\u2027\u2030-\u203a\u2190-\u2bff\U0001f300-\U0001faff"
_OTHER = re.compile(f"[^{_SETTLED}]")
#: letters that only differ in marks or by the key they were typed with, among the settled ones
_SIMPLE = (("\u200c", ""), ("ي", "ی"), ("ى", "ی"), ("ك", "ک"), ("آ", "ا"), ("أ", "ا"), ("إ", "ا"), ("ؤ", "و"), ("ئ", "ی"), *((chr(0x660 + d), chr(0x6F0 + d)) for d in range(10)))
_MARKS = re.compile("[" + _class([c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]) + "]+")
_FAR_MARKS = re.compile("[" + _class([c for c in (*range(0x10000, 0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c))[0] == "M"]) + "]+")
_FAR = re.compile("[\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]")
_SCRIPT = re.compile("[\u0370-\u052f]")
_HIDDEN = re.compile("[" + _class(sorted({*map(ord, INVISIBLE), *(c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cf")})) + "]+")
_BARE = re.compile(r"[^\W_]+")
_FOLD = {ord(a): b for a, b in TO_LATIN.items()}


def bare_list(text: str | None) -> list[str]:
    """The words of a stored text in order, in lower case and in one form: letters by their compatibility form and without marks,
    joiners and invisible characters, look-alike letters of other scripts as Latin ones."""
    if not text:
        return []
    if not text.isascii():
        if _OTHER.search(text):
            text = unicodedata.normalize("NFKC", text)
            if _SCRIPT.search(text):
                text = text.upper().translate(_FOLD)  # look-alikes of either case are folded alike
            text = _MARKS.sub("", unicodedata.normalize("NFD", _HIDDEN.sub("", text)))
            if _FAR.search(text):
                text = _FAR_MARKS.sub("", text)
            text = text.replace("ە", "ه")
        for a, b in _SIMPLE:
            text = text.replace(a, b)
    return _BARE.findall(text.casefold())


class WordNumbers(dict):
    """Blank-separated piece of a text -> numbers of its words (see :func:`bare_list`), remembered up to ``size`` pieces.

    number: a function from a word to its number. Pieces longer than ``longest`` are looked up but not remembered.
    """

    def __init__(self, number: Callable[[str], int], size: int = 300_000, longest: int = 60):
        super().__init__()
        self.number, self.size, self.longest = number, size, longest

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = tuple(map(self.number, bare_list(piece)))
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[piece] = out
        return out

    def of(self, text: str | None) -> list[int]:
        """The word numbers of a text in order."""
        return [n for piece in text.split() for n in self[piece]] if text else []
