"""Fitted models against plain loops."""

import math
import random

import numpy as np
import pytest

from tracemill.llm.language import train_bits
from tracemill.llm.quality import fit_logistic


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_logistic_is_the_minimum(seed):
    """No step from the fitted slope and intercept lowers the loss, summed row by row (it is convex)."""
    rng = random.Random(seed)
    y = [int(rng.random() < 0.3) for _ in range(200)]
    x = [rng.gauss(2 * k - 0.5, 1.5) for k in y]
    weight = [3.0 if k else 0.5 for k in y]

    def loss(slope, intercept):
        z = [slope * v + intercept for v in x]
        rows = sum(w * math.log1p(math.exp(-v if k else v)) for v, k, w in zip(z, y, weight))
        return rows + 1e-4 / 2 * (slope * slope + intercept * intercept)

    a, b = fit_logistic(np.array(x), np.array(y, float), np.array(weight))
    for step in (1e-1, 1e-2, 1e-3):
        assert all(loss(a, b) < loss(a + step * i, b + step * j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def test_bits_step_by_step():
    """Weights and biases of a few steps against the same momentum steps, number by number."""
    rng = random.Random(7)
    x = [[rng.random() for _ in range(4)] for _ in range(9)]
    signs = [[rng.choice([-1, 1]) for _ in range(3)] for _ in range(9)]
    steps, rate, ridge = 6, 2.0, 1e-2
    w, v = [[0.0] * 3 for _ in range(4)], [[0.0] * 3 for _ in range(4)]
    b, u = [0.0] * 3, [0.0] * 3
    for _ in range(steps):
        pull = [[s[k] / (1 + math.exp((sum(r[j] * w[j][k] for j in range(4)) + b[k]) * s[k])) / len(x) for k in range(3)] for r, s in zip(x, signs)]
        for k in range(3):
            for j in range(4):
                v[j][k] = 0.9 * v[j][k] + sum(r[j] * p[k] for r, p in zip(x, pull)) - ridge * w[j][k]
            u[k] = 0.9 * u[k] + sum(p[k] for p in pull)
        for k in range(3):
            for j in range(4):
                w[j][k] += rate * v[j][k]
            b[k] += rate * 0.1 * u[k]
    got_w, got_b = train_bits(np.array(x, np.float32), np.array(signs, np.float32), steps, rate, ridge)
    assert np.allclose(got_w, w, atol=1e-4) and np.allclose(got_b, b, atol=1e-4)
