"""Small numerical helpers of the classifiers, for bounded samples."""

from __future__ import annotations

import numpy as np


def descend(function, start: np.ndarray, rounds: int = 50, memory: int = 8) -> np.ndarray:
    """Smallest point of a smooth convex ``function`` (value and gradient), by limited-memory quasi-Newton steps."""
    x, (value, gradient) = start, function(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, alphas = gradient.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ direction) / (s @ y))
            direction -= alphas[-1] * y
        if pairs:
            direction *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            direction += (alpha - (y @ direction) / (s @ y)) * s
        step, fall = 1.0, gradient @ direction
        while (trial := function(x - step * direction))[0] > value - 1e-4 * step * fall and step > 1e-6:
            step /= 2
        s, y = -step * direction, trial[1] - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - trial[0] < 1e-7 * max(1.0, abs(value))
        x, (value, gradient) = x + s, trial
        if done:
            break
    return x


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Line that turns margins into log-odds of label 1, fitted to smoothed targets; the slope stays positive."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(margins).mean() or 1.0
    x = np.clip(margins / scale, -5, 5)

    def loss(line: np.ndarray) -> tuple[float, np.ndarray]:
        z = x * line[0] + line[1]
        slope = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        value = float((np.logaddexp(0, z) - target * z).mean()) + 1e-4 * float(line @ line)
        return value, np.array([(slope * x).mean(), slope.mean()]) + 2e-4 * line

    line = descend(loss, np.array([1.0, 0.0]), rounds=200)
    return max(float(line[0]) / scale, 1e-3), float(line[1])
