"""Licenses with blocks of words inserted, deleted and edited, against the full dynamic programme over the whole text."""

import random

import numpy as np
import pytest

from lumengrade.llm import license_scan as ls
from lumengrade.llm.minhash_dedup import _WordHash

LONG = [n for n, t in ls.TEMPLATES.items() if len(t.split()) >= ls.SHORT]
WORDS = _WordHash()
INDEX = ls.Index(ls.TEMPLATES)


def codes(words):
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def full_programme(template, text):
    """(score, matched) of the best alignment of the whole template anywhere in the text: +1 a match, -1 a difference, extra words at most 8 a run."""
    unit = 1 << 20
    row = np.zeros(len(text) + 1, np.int64)
    begun = np.zeros(len(text) + 1, bool)
    for i, want in enumerate(template):
        same = text == want
        step = np.where(same, row[:-1] + unit + 1, row[:-1] - unit)
        new = row - unit  # missing
        now = begun.copy()
        took = step > new[1:]
        new[1:] = np.where(took, step, new[1:])
        now[1:] = np.where(took, begun[:-1] | same, begun[1:])
        low = np.where(now, new, -(1 << 60))
        at = np.arange(len(new))
        extra = np.maximum(np.maximum.accumulate(low + at * unit)[:-1] - at[1:] * unit, np.maximum.accumulate(low)[:-1] - 8 * unit)
        better = extra > new[1:]
        new[1:], now[1:] = np.where(better, extra, new[1:]), now[1:] | better
        row, begun = new, now
    best = row.max()
    return best >> 20, best & (unit - 1)


def foreign(rng, n):
    return [b"x%d" % rng.randrange(10**6) for _ in range(n)]


def check(name, words, rng):
    text = foreign(rng, rng.randint(0, 60)) + words + foreign(rng, rng.randint(0, 60))
    got = [g for g in ls.scan([codes(text)], INDEX)[0] if g[0] == name]
    _, matched = full_programme(INDEX.codes[name], codes(text))
    return got, matched


@pytest.mark.parametrize("name", LONG)
def test_inserted_blocks(name):
    rng = random.Random(name)
    w = INDEX.words[name]
    for size in (1, 5, 9, 12, 40, 100, 200):
        for at in {len(w) // 2, len(w) // 3, rng.randrange(1, len(w)), len(w) - 3}:
            got, matched = check(name, w[:at] + foreign(rng, size) + w[at:], rng)
            assert len(got) == 1 and got[0][1] == matched, (size, at, got, matched)
    got, matched = check(name, w[: len(w) // 4] + foreign(rng, 30) + w[len(w) // 4 : len(w) // 2] + foreign(rng, 150) + w[len(w) // 2 :], rng)
    assert len(got) == 1 and got[0][1] == matched == len(w)


@pytest.mark.parametrize("name", LONG)
def test_deleted_blocks(name):
    rng = random.Random(name)
    w = INDEX.words[name]
    most = len(w) - int(np.ceil(0.8 * len(w)))
    for size in {1, 3, 9, most // 2, most} - {0}:
        for at in {0, len(w) // 2, rng.randrange(0, len(w) - size), len(w) - size}:
            if size <= most:
                got, matched = check(name, w[:at] + w[at + size :], rng)
                assert matched >= 0.8 * len(w) and len(got) == 1 and got[0][1] == matched, (size, at, got, matched)


@pytest.mark.parametrize("name", LONG)
def test_blocks_and_single_edits(name):
    rng = random.Random(name)
    w = INDEX.words[name]
    allowed = len(w) - int(np.ceil(0.8 * len(w)))
    for _ in range(12):
        words, left = list(w), rng.randint(0, allowed // 2)
        for _ in range(left):
            k = rng.randrange(len(words))
            words[k : k + rng.choice([0, 1])] = foreign(rng, rng.randint(0, 1))
        k = rng.randrange(len(words))
        words[k:k] = foreign(rng, rng.randint(10, 120))
        got, matched = check(name, words, rng)
        if matched >= 0.8 * len(w):
            assert len(got) == 1 and got[0][1] == matched, (got, matched)


def test_pieces_far_apart_and_copies_side_by_side():
    rng = random.Random(4)
    w = INDEX.words["MIT-full"]
    half = len(w) // 2
    assert check("MIT-full", w[:half] + foreign(rng, ls.GAP + 20) + w[half:], rng)[0] == []
    text = w + w[:half] + foreign(rng, 100) + w[half:] + foreign(rng, 3) + w
    got = [g for g in ls.scan([codes(text)], INDEX)[0] if g[0] == "MIT-full"]
    assert sorted(g[1] for g in got) == [len(w)] * 3


def test_enough_anchors_are_asked_for():
    """Edits spread as far as coverage allows leave at least need() anchors."""
    rng = random.Random(9)
    for name in LONG:
        w = INDEX.words[name]
        size = next(s for s, posting, _ in INDEX.parts for h in posting.values() if any(x[0] == name for x in h))
        allowed = len(w) - int(np.ceil(0.8 * len(w)))
        words = list(w)
        for k in range(allowed):
            words[(k + 1) * len(w) // (allowed + 1) - 1] = foreign(rng, 1)[0]
        posting = next(p for s, p, _ in INDEX.parts if s == size)
        at, code = ls.fingerprints(codes(words), *size)
        places = {there for h in code.tolist() for n, there in posting.get(h, ()) if n == name}
        assert len(places) >= ls.need(len(w), *size)
        got, matched = check(name, words, rng)
        assert len(got) == 1 and got[0][1] == matched
