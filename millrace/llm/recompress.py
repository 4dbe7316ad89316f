"""Recompression of word sequences: runs and pairs of symbols get content-derived global names.

A round replaces every maximal run of one symbol by a symbol for (symbol, length), or every pair of a
left symbol followed by a right one by a symbol for the pair.  Whether a symbol is left or right in a
round is a bit of its name, and a new name is a hash of what it stands for, so all documents of all
tasks agree on names and cuts without exchanging them: equal substrings get the same symbols, but for
some at their borders.

How far the borders reach is kept exactly: with each symbol goes the stretch of words that decided it
(its context).  Wherever that stretch occurs again, the symbol does too.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from millrace.llm.wordhash import BASE, INVERSE, mix, powers

#: Round by round: runs (r) or pairs (p).
SCHEDULE = "pprppp"
_PAIR, _RUN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Symbols(NamedTuple):
    """Symbols of one level in text order; words and borders between texts are numbered together."""

    name: np.ndarray
    start: np.ndarray
    low: np.ndarray  # the context is low:high
    high: np.ndarray
    border: np.ndarray  # stands between two texts, never part of a run or pair


def lay_out(h: np.ndarray, first: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Level 0, a border before each text and one at the end; and the number of each word."""
    n = len(first) - 1
    place = np.arange(len(h)) + np.repeat(np.arange(1, n + 1), np.diff(first))
    total = len(h) + n + 1
    name = np.zeros(total, np.uint64)
    border = np.ones(total, bool)
    name[place], border[place] = h, False
    at = np.arange(total, dtype=np.int32)
    return Symbols(name, at, at, at + 1, border), place


def pair_round(s: Symbols, salt: int) -> Symbols:
    left = (mix(s.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(s.name), bool)  # the symbol is first of a pair
    joins[:-1] = left[:-1] & ~left[1:] & ~s.border[:-1] & ~s.border[1:]
    second = np.zeros(len(joins), bool)
    second[1:] = joins[:-1]
    low, high = s.low.copy(), s.high.copy()
    # what stays alone does so because of its right (left symbols) or its left neighbour
    high[:-1] = np.where(left[:-1], s.high[1:], s.high[:-1])
    low[1:] = np.where(left[1:], s.low[1:], s.low[:-1])
    name = s.name.copy()
    one = np.flatnonzero(joins)
    name[one] = mix(s.name[one] * _PAIR + s.name[one + 1])
    low[one], high[one] = s.low[one], s.high[one + 1]
    keep = ~second
    return Symbols(name[keep], s.start[keep], low[keep], high[keep], s.border[keep])


def run_round(s: Symbols) -> Symbols:
    head = np.ones(len(s.name), bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | s.border[1:] | s.border[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(head)))
    last = at + size - 1
    name = s.name[at]
    many = size > 1
    name[many] = mix(name[many] * _RUN + size[many].astype(np.uint64))
    low = s.low[np.maximum(at - 1, 0)]
    high = s.high[np.minimum(last + 1, len(head) - 1)]
    return Symbols(name, s.start[at], low, high, s.border[at])


def levels(s: Symbols, schedule: str = SCHEDULE) -> list[Symbols]:
    out = [s]
    for salt, kind in enumerate(schedule, 1):
        out.append(pair_round(out[-1], salt) if kind == "p" else run_round(out[-1]))
    return out


def span_names(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each stretch ``low:high`` of the level-0 names ``h``."""
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h) * powers(BASE, n), out=total[1:])
    return mix((total[high] - total[low]) * powers(INVERSE, n + 1)[low] + (high - low).astype(np.uint64))


def anchors(stack: list[Symbols], window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, start) of the anchor of each window of ``size`` words starting at ``window``.

    The anchor is the first symbol of the highest level whose context lies inside the window, named by
    level, symbol and context.  It is decided by the window's words alone, so equal windows have equal
    anchors at equal offsets.
    """
    name = np.zeros(len(window), np.uint64)
    start = np.zeros(len(window), np.int64)
    todo = np.arange(len(window))
    h = stack[0].name
    for level in range(len(stack) - 1, -1, -1):
        s = stack[level]
        ok = np.flatnonzero(~s.border & (s.high - s.low <= size))
        low, high = s.low[ok], s.high[ok]
        k = np.searchsorted(low, window[todo])
        fits = k < len(ok)
        fits[fits] = high[k[fits]] <= window[todo[fits]] + size
        own = mix(s.name[ok] + span_names(h, low, high) + np.uint64(level))
        name[todo[fits]] = own[k[fits]]
        start[todo[fits]] = s.start[ok][k[fits]]
        todo = todo[~fits]
        if not len(todo):
            break
    return name, start
