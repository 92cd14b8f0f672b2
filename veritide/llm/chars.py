"""Code points of texts as numpy arrays, and their classes."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, UPPER, DIGIT, SPACE, LINE, STOP, PIPE, BANG, OTHER, SYMBOL = range(10)
_TABLES: dict = {}


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _table(name: str, rule, kind=np.uint8) -> np.ndarray:
    if name not in _TABLES:
        out = np.zeros(0x110000, kind)
        for i in range(0x110000):
            out[i] = rule(chr(i), i)
        _TABLES[name] = out
    return _TABLES[name]


def _class(c: str, i: int) -> int:
    if c in ".,;:?":
        return STOP
    if c in "|!\n":
        return {"|": PIPE, "!": BANG, "\n": LINE}[c]
    if c.isspace():
        return SPACE
    kind = unicodedata.category(c)
    if kind == "Lu":
        return UPPER
    if kind[0] in "LM":
        return LETTER
    if kind[0] == "N":
        return DIGIT
    return SYMBOL if i < 128 else OTHER


def classes(p: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    return _table("class", _class)[p]


def folded(p: np.ndarray) -> np.ndarray:
    """Letters in lower case; every other code point 32, so that only words count."""

    def rule(c, i):
        low = c.lower()
        return (ord(low) if len(low) == 1 else i) if c.isalpha() else 32

    return _table("folded", rule, np.uint32)[p]


assert sys.maxunicode == 0x10FFFF
