"""Recompression of word sequences: rounds that name runs of equal symbols, then pairs.

A round replaces each run of equal symbols by one symbol and then each adjacent pair
whose left symbol tosses heads and right symbol tails. A name is a digest of what it
stands for (the repeated symbol and its number, or the two symbols), so that equal
strings get equal names in whatever task they are, and a toss is a bit of the name and
the round. Names are carried upward: a symbol of round r stands for the words below it.

Each symbol knows its *reach*, the words that decided it: itself, the word on either
side (which tells that no run goes on) and the neighbour that it failed to pair with.
A symbol whose reach lies inside a window is part of every equal window, at the same
place, whatever surrounds them. A reach beyond the first or last word lies in no window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from intronaut.llm.words import U, Words, mix

#: Rounds: symbols of the last one stand for about six words.
ROUNDS = 6
_RUN, _TOSS = U(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


@dataclass
class Level:
    """Symbols of one round in text order: names, first word and end of each, and its reach ``low`` to ``high`` (exclusive)."""

    names: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray

    def at(self, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> Level:
        """Symbols that stand for the stretches from symbol ``left`` to symbol ``right``."""
        return Level(names, self.begin[left], self.end[right], self.low[left], self.high[right], self.row[left])


def _beside(level: Level, whole_left: np.ndarray, whole_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reach of each symbol and its neighbours: a neighbour's whole reach where asked for, else its nearest word."""
    low, high = level.begin - 1, level.end + 1
    inside = level.row[1:] == level.row[:-1]
    low[1:] = np.where(inside & whole_left[1:], level.low[:-1], low[1:])
    high[:-1] = np.where(inside & whole_right[:-1], level.high[1:], high[:-1])
    return np.minimum(low, level.low), np.maximum(high, level.high)


def name_runs(level: Level, words: np.ndarray) -> Level:
    """One symbol for each maximal run of equal symbols of a text."""
    first, last = words[level.begin], words[level.end - 1]
    # a neighbour whose nearest word differs from this symbol's own can't be the same symbol
    alike = np.zeros(len(first) + 1, bool)
    left, right = alike.copy()[:-1], alike[:-1]
    left[1:], right[:-1] = last[1:] == last[:-1], first[1:] == first[:-1]
    level.low, level.high = _beside(level, left, right)
    equal = (level.names[1:] == level.names[:-1]) & (level.row[1:] == level.row[:-1])
    if not equal.any():
        return level
    opens = np.flatnonzero(np.concatenate([[True], ~equal]))
    closes = np.append(opens[1:], len(first)) - 1
    length = (closes - opens + 1).astype(U)
    names = level.names[opens]
    return level.at(opens, closes, np.where(length > 1, mix(mix(names) + length * _RUN), names))


def name_pairs(level: Level, number: int) -> Level:
    """One symbol for each pair of heads and tails; others stay, and reach to the neighbour that kept them single."""
    heads = (mix(level.names + U(number * _TOSS % 2**64)) >> U(63)).astype(bool)
    pair = heads[:-1] & ~heads[1:] & (level.row[1:] == level.row[:-1])
    left, right = np.append(pair, False), np.concatenate([[False], pair])
    single = ~left & ~right
    low, high = _beside(level, single & ~heads, single & heads)
    level.low, level.high = np.where(single & ~heads, low, level.low), np.where(single & heads, high, level.high)
    names = np.where(left, mix(level.names * U(3) + mix(np.append(level.names[1:], U(0))) + U(number)), level.names)
    opens = np.flatnonzero(~right)
    return level.at(opens, opens + left[opens], names[opens])


def parse(words: Words, rounds: int = ROUNDS) -> list[Level]:
    """The words themselves and the symbols after each round."""
    n = len(words.codes)
    begin = np.arange(n)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    levels = [Level(words.codes, begin, begin + 1, begin.copy(), begin + 1, row)]
    for number in range(1, rounds + 1):
        now = levels[-1]
        now = Level(now.names, now.begin, now.end, now.low, now.high, now.row)
        if len(now.names) > 1:
            now = name_pairs(name_runs(now, words.codes), number)
        levels.append(now)
    return levels


def elect(words: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, symbol's place, symbol) of every window: the highest symbol that reaches no further than the window.

    Of several such symbols of one round that of least digest is taken, then the leftmost. A word reaches itself only, so
    every window has a symbol.
    """
    n = len(words.codes)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    if n < window:
        return row[:0], row[:0], row[:0], words.codes[:0]
    start = np.flatnonzero(row[window - 1 :] == row[: n - window + 1])
    place, symbol, open_ = np.zeros(n, np.int64), np.zeros(n, U), start
    for level in reversed(parse(words, rounds)):
        if not len(open_):
            break
        short = level.high - level.low <= window
        names, begin, low, high = (x[short] for x in (level.names, level.begin, level.low, level.high))
        if not len(names):
            continue
        # reaches move on with the symbols, so those inside a window are neighbours
        leftmost, rightmost = np.searchsorted(low, open_), np.searchsorted(high, open_ + window, "right") - 1
        some = leftmost <= rightmost
        at, best, last = open_[some], leftmost[some], rightmost[some]
        votes, step, now = mix(names ^ _RUN), 0, best
        while len(now) and (now < last).any():
            step += 1
            now = np.minimum(leftmost[some] + step, last)
            best = np.where(votes[now] < votes[best], now, best)
        place[at], symbol[at] = begin[best], names[best]
        open_ = open_[~some]
    return row[start], start, place[start], symbol[start]
