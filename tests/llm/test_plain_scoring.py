"""Scores of the fitted models against sums made one feature at a time."""

import math
import random

import numpy as np
import pytest

from slipscope.llm import quality, toxicity
from slipscope.llm import textbatch as tb

M = 2**64


def mix(x):
    x %= M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def word_hash(w):
    return int(tb.words([w]).hashes()[0])


def texts(n, seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "NASA", "x###y", "the", "the", "a", "é", "idiotic", "idiot", "w" * 30, "12", "\n", ""]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))).encode() for _ in range(n)] + [b"", b"x", b"xy", b"  "]


def test_quality_line_is_the_sum_of_mean_weights():
    some = texts(120, 1)
    model = quality.fit(some, np.array([i % 3 for i in range(len(some))], float), np.ones(len(some)))
    want = []
    for t in some:
        data, line = t + b" ", 0.0
        grams = [data[i : i + 3] for i in range(len(data) - 2)] if len(t) > 1 else []
        if grams:
            line += quality.SCALE * sum(model.weights[mix((g[0] << 16 | g[1] << 8 | g[2]) + 1) >> 46] for g in grams) / len(grams)
        words = t.split()
        low = [w.lower() for w in words]
        marks = [0.0] * 4
        for i, w in enumerate(words):
            line += quality.SCALE * model.weights[mix(word_hash(low[i]) + 7) >> 46] / len(words)
            capitals, small = sum(65 <= c <= 90 for c in w), sum(97 <= c <= 122 for c in w)
            odd = any(32 < c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?" for c in w)
            for j, mark in enumerate((i > 0 and low[i] == low[i - 1], capitals >= 2 and not small, odd, len(w) > 24)):
                marks[j] += mark
        line += sum(quality.SCALE * model.weights[(1 << quality.BITS) + j] * m / max(len(words), 1) for j, m in enumerate(marks))
        want.append(line)
    assert model.line(some) == pytest.approx(want, abs=1e-9)
    expected, tail = model.scores(some, 1.0)
    below = [[1 / (1 + math.exp(x - th)) for th in model.thresholds] for x in want]
    assert tail == pytest.approx([1 - b[0] for b in below]) and expected == pytest.approx([(1 - b[0]) + (1 - b[1]) for b in below])


def test_a_hundred_grades_are_all_learned():
    r = random.Random(3)
    grades = np.array([float(i % 100) for i in range(400)])
    some = [" ".join([f"g{int(g)}"] * 20 + [r.choice("abc")]).encode() for g in grades]
    assert quality.fit(some, grades, np.ones(400)).grades == [float(i) for i in range(100)]


def test_chain_is_the_sum_of_weights_and_earlier_log_odds():
    some = texts(200, 2)
    y = np.array([[b"idiot" in t, b"idiot" in t and b"NASA" in t] for t in some], int)
    chain = toxicity.fit(some, np.arange(len(some)), y, np.ones(len(some)), ["one", "two"])
    assert any(len(link.features) for link in chain.links)
    want = []
    for t in some:
        low = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) for c in t).encode("latin-1")
        words = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in low).split(b" ")
        found = set()
        for w in filter(None, words):
            found.add(mix(word_hash(w) + 3) >> 44)
            for i in (3, 4, 5):
                if len(w) > i:
                    found.add(mix(int.from_bytes(w[: i + 1], "little") + (i << 56)) >> 44)
        odds = []
        for link in chain.links:
            weight = dict(zip(link.features.tolist(), link.weights.tolist()))
            x = link.bias + sum(weight.get(f, 0.0) for f in found) + sum(a * b for a, b in zip(odds, link.earlier.tolist()))
            odds.append(max(-30.0, min(30.0, x)))
        want.append([1 / (1 + math.exp(-x)) for x in odds])
    assert chain.probabilities(some) == pytest.approx(np.array(want), abs=1e-9)
