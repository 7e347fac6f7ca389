"""Solvers that ask for what they need: many fits advance together, and one pass over the data answers all of them.

A solver is a generator. It yields a point and is sent what was summed there; ``together`` gathers the points of all fits
that have not ended, has them answered at once, and hands out the answers. So the number of passes is that of the
longest fit, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Hashable
from typing import Any

import numpy as np

#: A point is yielded, sums are sent, and the solution is returned.
Solver = Generator[Any, Any, Any]


def together(solvers: dict[Hashable, Solver], answer: Callable[[dict[Hashable, Any]], dict[Hashable, Any]]) -> dict[Hashable, Any]:
    """The solutions of all solvers by their names."""
    done: dict[Hashable, Any] = {}
    asked: dict[Hashable, Any] = {}

    def step(name: Hashable, sent: Any) -> None:
        try:
            asked[name] = solvers[name].send(sent)
        except StopIteration as end:
            done[name] = end.value

    for name in solvers:
        step(name, None)
    while asked:
        points, asked = asked, {}
        for name, sums in answer(points).items():
            step(name, sums)
    return done


def lbfgs(start: np.ndarray, tolerance: float = 1e-12, steps: int = 300, memory: int = 10) -> Solver:
    """Least point of a smooth convex function: yields points, gets (value, gradient). Ends when no component of the gradient exceeds the tolerance."""
    x = start
    value, g = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        direction = -g
        weights = []
        for s, y in reversed(past):
            weights.append(float(s @ direction) / float(s @ y))
            direction = direction - weights[-1] * y
        if past:
            s, y = past[-1]
            direction = direction * (float(s @ y) / float(y @ y))
        for (s, y), w in zip(past, reversed(weights)):
            direction = direction + (w - float(y @ direction) / float(s @ y)) * s
        slope = float(g @ direction)
        if slope >= 0:
            past, direction, slope = [], -g, -float(g @ g)
        length = 1.0 if past else min(1.0, 1.0 / float(np.abs(g).sum()))
        while True:
            fresh, fresh_g = yield x + length * direction
            if fresh <= value + 1e-4 * length * slope:
                break
            if abs(fresh - value) <= 1e-13 * max(1.0, abs(value)):
                # Near the end values differ by less than they are told apart; the gradient decides there.
                if np.abs(fresh_g).max() < np.abs(g).max():
                    break
                return x
            length /= 2
            if length < 1e-9:
                return x
        moved, turned = length * direction, fresh_g - g
        if float(moved @ turned) > 1e-18:
            past = [*past, (moved, turned)][-memory:]
        x, value, g = x + moved, fresh, fresh_g
    return x


def newton_sigmoid(mean: float, tolerance: float = 1e-12, steps: int = 100) -> Solver:
    """Slope and intercept of a sigmoid, by Newton's method with halving: yields (slope, intercept), gets the mean loss, its
    gradient (2) and its second derivatives (slope twice, mixed, intercept twice). mean: of the targets."""
    at = np.array([0.0, math.log(mean / (1 - mean))])
    loss, g, h = yield at
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        # Equal margins leave the slope open: a trace of a ridge keeps it where it is.
        step = np.linalg.solve(np.array([[h[0], h[1]], [h[1], h[2]]]) + 1e-15 * np.eye(2) * max(1.0, h[0] + h[2]), -np.asarray(g))
        length = 1.0
        while True:
            fresh = yield at + length * step
            if fresh[0] <= loss + 1e-15 * max(1.0, abs(loss)) or length < 1e-9:
                break
            length /= 2
        at, (loss, g, h) = at + length * step, fresh
        if length < 1e-9:
            break
    return float(at[0]), float(at[1])
