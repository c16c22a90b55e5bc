"""Pre-tokenisation without a regular expression: class arrays and a scan of transition functions.

A text is an array of code points. A table gives each code point a class (letter, number, space, other
white space, other); a few vector comparisons with the next positions refine it (white space that stands
last before something else, an apostrophe before s, t, m, d, re, ve or ll). Over these classes a small
automaton decides before which characters a new token starts. A class is then a function from states to
states; function composition is associative, so all states come from one prefix scan: products within
blocks for all blocks side by side, a short scan over the blocks' products, one look-up for the result. The
functions that can arise are few (their closure is computed once), so a product is one look-up in a table.

Rules scanned (those of the public byte-level pattern, in order of precedence): contractions after an
apostrophe; an optional space and letters; an optional space and numbers; an optional space and other
characters; white space up to the last one before something else; white space.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

#: Classes of characters. RESET stands between texts.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_SPACE, LAST_OTHER, RESET = range(9)
#: States: in letters, numbers, others or white space; after a space that opens a token; in a contraction
#: with one or two letters to come; at a point where whatever follows opens a token.
S_LETTER, S_NUMBER, S_OTHER, S_SPACES, S_OPEN, S_ONE, S_TWO, S_FREE = range(8)
BLOCK = 256
#: White space of the pattern.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if kind == LETTER:
        if state == S_TWO:
            return S_ONE, False
        if state == S_ONE:
            return S_FREE, False
        return S_LETTER, state not in (S_LETTER, S_OPEN)
    if kind == NUMBER:
        return S_NUMBER, state not in (S_NUMBER, S_OPEN)
    if kind == OTHER or kind in (SHORT, LONG) and state in (S_OTHER, S_OPEN):
        return S_OTHER, state not in (S_OTHER, S_OPEN)
    if kind == SHORT:
        return S_ONE, True
    if kind == LONG:
        return S_TWO, True
    if kind == SPACES:
        return S_SPACES, state != S_SPACES
    if kind == LAST_SPACE:
        return S_OPEN, True
    return S_FREE, True  # LAST_OTHER, RESET


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(function of each class, products, starts, width). There are width functions; function f is written as
    f * width in products[f * width + g] = (g after f) * width, and starts[kind, state * width ** 2 + f * width]
    tells whether a token starts at a character of that kind if f leads there from that state."""
    kinds, states = range(9), range(8)
    functions = {tuple(states): 0}
    first = [functions.setdefault(tuple(step(s, k)[0] for s in states), len(functions)) for k in kinds]
    todo = list(functions)
    while todo:
        f = todo.pop()
        for k in kinds:
            g = tuple(step(s, k)[0] for s in f)
            if g not in functions:
                functions[g] = len(functions)
                todo.append(g)
    rows, width = list(functions), len(functions)
    product = np.array([[functions[tuple(g[s] for s in f)] * width for g in rows] for f in rows], dtype=np.uint8)
    reached = np.zeros((8, width, width), dtype=np.uint8)
    reached[:, :, 0] = np.array(rows, dtype=np.uint8).T
    return np.array(first, dtype=np.uint8), product.ravel(), reached.ravel(), width


@functools.cache
def starts() -> np.ndarray:
    return np.array([[step(s, k)[1] for s in range(8)] for k in range(9)]).ravel()


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[list(WHITE)] = SPACES
    return table


def states_before(kinds: np.ndarray) -> np.ndarray:
    """State of the automaton before each character, from the state S_FREE."""
    of_kind, product, reached, width = automaton()
    n, rows = len(kinds), -(-len(kinds) // BLOCK)
    padded = np.full(rows * BLOCK, RESET, dtype=np.uint8)
    padded[:n] = kinds
    blocks = np.ascontiguousarray(of_kind[padded].reshape(rows, BLOCK).T)  # [position in block, block]
    before = np.empty((BLOCK, rows), dtype=np.uint8)
    so_far = np.zeros(rows, dtype=np.uint8)  # the identity
    for i in range(BLOCK):
        before[i] = so_far
        so_far = product[so_far + blocks[i]]
    enter = np.empty(rows, dtype=np.uint16)
    state = S_FREE
    for i, f in enumerate(so_far.tolist()):
        enter[i] = state * width * width
        state = int(reached[state * width * width + f])
    return reached[before + enter].T.ravel()[:n]


def boundaries(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a token starts. codes: code points of texts, each followed by a mark; ends: the marks' places."""
    kinds = classes()[codes]
    kinds[ends] = RESET
    white = kinds == SPACES
    closing = np.zeros(len(codes), dtype=bool)
    closing[:-1] = white[:-1] & ~white[1:] & (kinds[1:] != RESET)
    kinds[closing] = LAST_OTHER
    kinds[closing & (codes == 32)] = LAST_SPACE
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        after = np.concatenate([codes, np.zeros(2, dtype=codes.dtype)])
        one, two = after[marks + 1], after[marks + 2]
        kinds[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[marks[pairs]] = LONG
    return starts()[(kinds << 3) + states_before(kinds)]


def cut_points(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of the texts, each followed by a mark; first byte and first code point of every pre-token, of
    every text, and of the end; first pre-token of every text and of the end). A mark is no pre-token."""
    joined = "\n".join(texts) + "\n" if texts else ""
    data = joined.encode("utf-8", "surrogatepass")
    ascii_ = len(data) == len(joined)
    codes = np.frombuffer(data, dtype=np.uint8) if ascii_ else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    at = np.flatnonzero(boundaries(codes, ends)) if len(texts) else np.zeros(0, dtype=np.int64)
    at = np.append(at, len(joined))
    bounds = np.concatenate([[0], np.searchsorted(at, ends) + 1])  # each mark starts a token of its own
    if ascii_:
        return data, at, at, bounds, ends
    first = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)  # first byte of each character
    return data, np.append(first, len(data))[at], at, bounds, ends


def split_batch(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    data, places, _, bounds, _ = cut_points(texts)
    cuts, whole = places.tolist(), bounds.tolist()
    return [[data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(cuts[a : b - 1], cuts[a + 1 : b])] for a, b in zip(whole, whole[1:])]


def chunks(texts: list[str], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text stands alone."""
    found, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            found.append((first, i))
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        found.append((first, len(texts)))
    return found
