"""Vectorised pre-tokenisation: class arrays and a scan of transition functions.

The pattern that splits a text is read as a finite automaton over character
classes. A character's symbol is its class, with a look at its neighbours: a
space before a word is told from one inside a run of white space, and an
apostrophe before a contraction's letters from any other. Each symbol maps the
eight states to states; such maps compose associatively, so blocks of
characters are first composed side by side, then the blocks' maps are scanned,
and a second pass with every block's true entry state marks the boundaries.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

from geonear.llm.codepoints import LETTER, N_CODES, NUMBER, SPACE, codes_of

BLOCK = 256  # characters composed one after another; the blocks run side by side
TAIL = 8  # characters at a block's end that are tried first

# Symbols. A symbol plus FIRST is the same at the start of a text.
_WORD, _DIGITS, _MARKS, _INNER, _LAST, _BEFORE, _SHORT, _LONG = range(8)
FIRST = 8
# States: what the character just read belongs to.
_FREE, _IN_WORD, _IN_DIGITS, _IN_MARKS, _IN_SPACE, _LEAD, _ONE_LEFT, _TWO_LEFT = range(8)

#: The contractions of the pattern, by the letters after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def library_classes() -> np.ndarray:
    """The class of every code point as the rank files' own library sees it.

    The library is asked once, for all code points, which of them are letters,
    numbers and white space, so that both follow the same version of Unicode.
    """
    every = [c for c in range(N_CODES) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    table = np.zeros(N_CODES, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        asked = tiktoken.Encoding("classes", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={bytes([b]): b for b in range(256)})
        table[codes_of(asked.decode(asked.encode_ordinary(text)))] = kind
    table.flags.writeable = False
    return table


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a slice starts here", both indexed ``symbol * 8 + state``."""
    to = np.zeros((16, 8), np.int64)
    cut = np.ones((16, 8), bool)
    runs = {_WORD: _IN_WORD, _DIGITS: _IN_DIGITS, _MARKS: _IN_MARKS}
    for symbol, state in runs.items():
        to[symbol] = state
        cut[symbol, [state, _LEAD]] = False
    # The letters that a contraction still expects.
    to[_WORD, _ONE_LEFT], to[_WORD, _TWO_LEFT] = _FREE, _ONE_LEFT
    cut[_WORD, [_ONE_LEFT, _TWO_LEFT]] = False
    for symbol, state in ((_SHORT, _ONE_LEFT), (_LONG, _TWO_LEFT)):
        to[symbol] = state  # only where a slice starts; else one of the marks
        to[symbol, [_IN_MARKS, _LEAD]] = _IN_MARKS
        cut[symbol, [_IN_MARKS, _LEAD]] = False
    to[_INNER], to[_LAST], to[_BEFORE] = _IN_SPACE, _FREE, _LEAD
    cut[_INNER, _IN_SPACE] = False
    to[FIRST:] = to[:FIRST, [_FREE]]
    return to.reshape(-1), cut.reshape(-1)


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """The symbol of every code point, white space taken as inside a run."""
    of_class = np.full(4, _MARKS, np.uint8)
    of_class[LETTER], of_class[NUMBER], of_class[SPACE] = _WORD, _DIGITS, _INNER
    return of_class[library_classes()]


def _symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(codes)
    symbol = _symbol_table()[codes]
    last = np.zeros(n, bool)  # of its text
    last[np.concatenate([starts[1:], [n]]) - 1] = True
    space = symbol == _INNER
    alone = space & ~last  # neither white space nor the text's end follows
    alone[:-1] &= ~space[1:]
    alone = np.flatnonzero(alone)
    symbol[alone] = np.where(codes[alone] == 32, _BEFORE, _LAST)
    at = np.flatnonzero(codes == 39)
    if len(at):
        ahead = lambda k: np.where(at + k < n, codes[np.minimum(at + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        one = np.where(last[at], 0, one)
        two = np.where((one == 0) | last[np.minimum(at + 1, n - 1)], 0, two)
        for c in CONTRACTIONS:
            if len(c) == 1:
                symbol[at[one == ord(c)]] = _SHORT
            else:
                symbol[at[(one == ord(c[0])) & (two == ord(c[1]))]] = _LONG
    symbol[starts] += FIRST
    return symbol


def _composed(steps: np.ndarray) -> np.ndarray:
    """The map of the states that a run of symbols gives, for each column of ``steps``."""
    to = _machine()[0]
    maps = np.tile(np.arange(8), (steps.shape[1], 1))
    for step in steps:
        maps = to[step[:, None] + maps]
    return maps


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First character of every slice of texts laid end to end.

    ``starts`` are the texts' first characters; texts must not be empty.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    to, cut = _machine()
    rows = -(-n // BLOCK)
    symbol = np.full(rows * BLOCK, _MARKS, np.uint8)
    symbol[:n] = _symbols(codes, starts)
    symbol = np.ascontiguousarray(symbol.reshape(rows, BLOCK).T) * np.uint8(8)
    # One map of the states per block, all blocks at once. Where a block's last
    # symbols lead every state to the same one, those before them don't matter.
    maps = _composed(symbol[-TAIL:])
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_):
        maps[open_] = _composed(symbol[:, open_])
    # Inclusive scan over the blocks: after it, maps[i] is blocks 0..i composed.
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.concatenate([[_FREE], maps[:-1, _FREE]])
    found = np.empty((BLOCK, rows), bool)
    for i, step in enumerate(symbol):
        at = step + state
        found[i] = cut[at]
        state = to[at]
    return np.flatnonzero(found.T.reshape(-1)[:n])


def slice_bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as UTF-8 laid end to end, and where slices begin in it, with the end.

    Then the first slice of each text, with the end: those of text ``i`` are
    ``first[i]`` to ``first[i + 1]``. Last, the first byte of each text.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    joined = "".join(texts)
    full = sizes > 0
    cuts = boundaries(codes_of(joined), (ends - sizes)[full])
    data = joined.encode("utf-8", "surrogatepass")
    begin, text_begin = cuts, ends - sizes
    if len(data) > len(joined):
        # A character begins at every byte that doesn't go on with another.
        place = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
        begin, text_begin = place[begin], place[text_begin]
    first = np.searchsorted(cuts, np.concatenate([[0], ends]))
    return data, np.append(begin, len(data)), first, text_begin


def byte_slices(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All slices in order as UTF-8, where each text's begin, and each slice's first byte in its text.

    Slices of text ``i`` are ``slices[first[i]:first[i + 1]]``.
    """
    data, begin, first, text_begin = slice_bounds(texts)
    at = begin.tolist()
    slices = [data[a:b] for a, b in zip(at, at[1:])]
    return slices, first, begin[:-1] - np.repeat(text_begin, np.diff(first))
