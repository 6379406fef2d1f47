"""Vectorised pre-tokenisation without a regex.

The split pattern (contractions | ' '?letters | ' '?digits | ' '?others |
white space) is a small automaton. Every code point becomes a class, every
class a function on the automaton's states; composing functions is
associative, so the states of a whole batch of texts come from a blocked
prefix scan of function numbers (each composition is one table lookup). A
token begins wherever (state before, class) says so.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# Code points with the Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings after an apostrophe that form one token with it.
SHORT_ENDINGS = "sdmt"
LONG_ENDINGS = ("ll", "ve", "re")

# classes of code points; the first four come from a table, the others from one or two following code points
OTHER, LETTER, DIGIT, SPACE, MARK1, MARK2, BLANK_END, SPACE_END = range(8)
# states: what the last code point left behind
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, whether a token begins at this code point)."""
    if state in (ONE_MORE, TWO_MORE):               # inside a contraction: its letters follow for certain
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if cls == SPACE:                                # white space with more white space (or the end) behind it
        return IN_SPACE, state != IN_SPACE
    if cls == BLANK_END:                            # last blank before a visible character: belongs to that token
        return AFTER_BLANK, True
    if cls == SPACE_END:                            # other white space before a visible character: its own token
        return FRESH, True
    if cls in (MARK1, MARK2) and state not in (IN_OTHER, AFTER_BLANK):
        return (ONE_MORE if cls == MARK1 else TWO_MORE), True
    run = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS}.get(cls, IN_OTHER)
    return run, state not in (run, AFTER_BLANK)


@lru_cache(1)
def _tables():
    """Class per code point, the functions reachable by composition, their
    composition table, and the begin flag per (state, class)."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = LETTER if k == "L" else DIGIT
    kind[list(WHITE_SPACE)] = SPACE
    start = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
    base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    base += [(t[FRESH],) * 8 for t in base]         # the same, after a reset: first code point of a text
    base.append(tuple(range(8)))                    # identity
    funcs = list(dict.fromkeys(base))
    at = {f: i for i, f in enumerate(funcs)}
    pairs = {}
    done = 0
    while done < len(funcs):
        f = funcs[done]
        done += 1
        for g in list(base):
            h = tuple(g[s] for s in f)
            if h not in at:
                at[h] = len(funcs)
                funcs.append(h)
    for i, f in enumerate(funcs):
        for j, g in enumerate(funcs):
            h = tuple(g[s] for s in f)
            if h not in at:
                at[h] = len(funcs)
                funcs.append(h)
            pairs[i, j] = at[h]
    n = len(funcs)
    comp = np.zeros((n, n), np.uint16)
    for i, f in enumerate(funcs):
        for j, g in enumerate(funcs):
            comp[i, j] = at[tuple(g[s] for s in f)]
    of_class = np.array([at[b] for b in base], np.uint16)
    return kind, of_class, comp.ravel(), n, np.array(funcs, np.uint8), start, at[tuple(range(8))]


def _scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each position, for function numbers f: prefixes inside
    blocks, then (recursively) the states at the block borders."""
    _, _, comp, n, act, _, identity = _tables()
    if len(f) <= width:
        state, out = FRESH, np.empty(len(f), np.uint8)
        for i, g in enumerate(f):
            out[i] = state
            state = act[g, state]
        return out
    rows = -(-len(f) // width)
    padded = np.full(rows * width, identity, np.uint16)
    padded[:len(f)] = f
    cols = np.ascontiguousarray(padded.reshape(rows, width).T)
    pre = np.empty_like(cols)                       # composition of everything before the position, in its block
    pre[0] = identity
    acc = cols[0]
    for j in range(1, width):
        pre[j] = acc
        acc = comp[acc.astype(np.int32) * n + cols[j]]
    carry = _scan(acc, width)                       # state at the start of each block
    states = act.ravel()[pre.astype(np.int32) * 8 + carry[None, :]]
    return states.T.reshape(-1)[:len(f)]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte offset of every token plus the total,
    number of tokens per text). Lone surrogates are encoded as '?'."""
    kind, of_class, _, _, _, begins, _ = _tables()
    joined = "".join(texts)
    raw = joined.encode("utf-8", "replace")
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if not len(code):
        return raw, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    cls = kind[code]
    first = np.zeros(len(code) + 2, bool)           # first code point of a text; also closes the last one
    first[(ends - sizes)] = True
    first[len(code):] = True
    # white space whose successor is visible
    space = cls == SPACE
    follows = np.zeros(len(code), bool)
    follows[:-1] = ~space[1:] & ~first[1:len(code)]
    last = np.flatnonzero(space & follows)
    cls[last] = np.where(code[last] == 0x20, BLANK_END, SPACE_END)
    # apostrophes before an ending
    marks = np.flatnonzero(code == 0x27)
    if len(marks):
        tail = np.concatenate([code, np.zeros(2, np.uint32)])
        a = np.where(first[marks + 1], 0, tail[marks + 1])
        b = np.where(first[marks + 1] | first[marks + 2], 0, tail[marks + 2])
        cls[marks[np.isin(a, [ord(c) for c in SHORT_ENDINGS])]] = MARK1
        for e in LONG_ENDINGS:
            cls[marks[(a == ord(e[0])) & (b == ord(e[1]))]] = MARK2
    first = first[:len(code)]
    before = _scan(of_class[cls + 8 * first.astype(np.uint8)])
    is_start = begins.ravel()[before.astype(np.int16) * 8 + cls] | first
    at = np.flatnonzero(is_start)
    if len(raw) == len(code):
        offsets = at
    else:
        leads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)       # first byte of every code point
        offsets = leads[at]
    # tokens per text
    upto = np.searchsorted(at, ends, "left")
    counts = np.diff(upto, prepend=0)
    return raw, np.append(offsets, len(raw)).astype(np.int64), counts
