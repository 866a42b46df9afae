"""Texts as arrays of code points, with per-code-point tables made by rule."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

N_CODES = 0x110000

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
OTHER, LETTER, NUMBER, SPACE = range(4)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """``OTHER``, ``LETTER`` (L*), ``NUMBER`` (N*) or ``SPACE`` per code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(N_CODES)), np.uint8, N_CODES)
    table[list(WHITE_SPACE)] = SPACE
    table.flags.writeable = False
    return table


@lru_cache(maxsize=1)
def folded_letters() -> np.ndarray:
    """Lower-case letter per code point; anything else is one blank."""
    table = np.full(N_CODES, 32, np.uint32)
    for c in np.flatnonzero(class_table() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    table.flags.writeable = False
    return table
