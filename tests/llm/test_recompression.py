"""Recompression: names stand for one string each, and equal substrings have equal interior symbols."""

import random

import numpy as np
import pyarrow as pa
import pytest

from intronaut.llm.recompression import ROUNDS, elect, parse
from intronaut.llm.words import split_words


def parsed(texts, chunk=1 << 20, overlap=0):
    return list(split_words(pa.array(texts), chunk=chunk, overlap=overlap))


def sample(vocabulary, n, rnd):
    return [f"v{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [1, 2, 40, 5000])
def test_a_name_stands_for_one_string(vocabulary):
    rnd = random.Random(vocabulary)
    texts = [sample(vocabulary, rnd.choice([0, 1, 2, 90, 400]), rnd) for _ in range(30)]
    (words,) = parsed([" ".join(t) for t in texts])
    flat = [w for t in texts for w in t]
    meaning, sizes = {}, []
    for level in parse(words):
        spans = list(zip(level.begin.tolist(), level.end.tolist(), strict=True))
        assert [x for a, b in spans for x in range(a, b)] == list(range(len(flat)))  # symbols tile the text
        assert all(int(words.offsets[r]) <= a and b <= int(words.offsets[r + 1]) for (a, b), r in zip(spans, level.row.tolist(), strict=True))
        for name, (a, b) in zip(level.names.tolist(), spans, strict=True):
            assert meaning.setdefault(name, flat[a:b]) == flat[a:b]
        sizes.append(len(spans))
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == ROUNDS + 1
    assert len({tuple(m) for m in meaning.values()}) <= len(meaning)


@pytest.mark.parametrize("vocabulary", [2, 60, 5000])
def test_symbols_within_reach_stand_in_every_occurrence(vocabulary):
    rnd = random.Random(vocabulary)
    passage = sample(vocabulary, 80, rnd)
    sides = [(sample(vocabulary, rnd.randrange(50), rnd), sample(vocabulary, rnd.randrange(50), rnd)) for _ in range(20)] + [([], [])]
    (words,) = parsed([" ".join(a + passage + b) for a, b in sides])
    seen = []
    for i, (left, _) in enumerate(sides):
        low = int(words.offsets[i]) + len(left)
        inside = []
        for k, level in enumerate(parse(words)):
            mine = (level.low >= low) & (level.high <= low + len(passage))
            inside += [(k, n, b - low, e - low) for n, b, e in zip(level.names[mine].tolist(), level.begin[mine].tolist(), level.end[mine].tolist(), strict=True)]
        seen.append(set(inside))
    assert all(s == seen[0] for s in seen)
    assert vocabulary < 60 or max(k for k, *_ in seen[0]) == ROUNDS


def test_equal_windows_elect_equal_symbols():
    rnd = random.Random(4)
    pool = sample(300, 200, rnd)
    texts = []
    for _ in range(40):
        at = rnd.randrange(120)
        texts.append(sample(300, rnd.randrange(40), rnd) + pool[at : at + 80] + sample(300, 3, rnd))
    texts += [["one"] * 90, ["one", "two"] * 60]
    (words,) = parsed([" ".join(t) for t in texts])
    found = {}
    for row, start, place, symbol in zip(*(x.tolist() for x in elect(words, 35)), strict=True):
        window = tuple(texts[row][start - int(words.offsets[row]) :][:35])
        assert found.setdefault(window, (place - start, symbol)) == (place - start, symbol)


def test_pieces_of_a_long_text_elect_as_the_whole():
    rnd = random.Random(2)
    text = " ".join(sample(400, 3000, rnd))
    (whole,) = parsed([text])
    _, start, place, symbol = elect(whole, 35)
    pieces = parsed([text], 900, 34)
    assert len(pieces) > 10 and pieces[-1].base + len(pieces[-1].codes) == 3000
    got = [np.concatenate(x) for x in zip(*((p.base + s, p.base + at, name) for p in pieces for _, s, at, name in [elect(p, 35)]), strict=True)]
    assert all((a == b).all() for a, b in zip(got, (start, place, symbol), strict=True))
