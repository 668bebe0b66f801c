"""Limited-memory quasi-Newton descent."""

from __future__ import annotations

import numpy as np


def descend(loss, w: np.ndarray, steps: int, memory: int = 12) -> np.ndarray:
    """Minimum of a smooth convex function by limited-memory quasi-Newton steps with backtracking."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, held = grad.copy(), []
        for s, g, k in past[::-1]:
            held.append(k * (s @ d))
            d -= held[-1] * g
        if past:
            s, g, k = past[-1]
            d *= 1 / (k * (g @ g))
        for (s, g, k), a in zip(past, held[::-1], strict=True):
            d += s * (a - k * (g @ d))
        slope, step = grad @ d, 1.0 if past else 1 / max(1e-12, float(np.abs(grad).sum()))
        while True:
            after, found = loss(w - step * d)
            if after <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, g = -step * d, found - grad
        w = w + s
        small = value - after < 1e-9 * max(1.0, abs(value))
        value, grad = after, found
        if s @ g > 1e-14:
            past = [*past[-memory + 1 :], (s, g, 1 / (s @ g))]
        if small:
            break
    return w
