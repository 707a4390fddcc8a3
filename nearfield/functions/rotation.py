"""Seeded orthogonal rotation: permutation (if needed), signs, block Walsh-Hadamard transforms."""

from __future__ import annotations

import numpy as np


def blocks(dims: int) -> list[int]:
    """Powers of two, largest first, that add up to dims."""
    return [1 << b for b in range(dims.bit_length() - 1, -1, -1) if dims >> b & 1]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows of x (a power of two wide); its own inverse."""
    n = x.shape[1]
    y = x.astype(np.float64)
    half = 1
    while half < n:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
        half *= 2
    return y.reshape(len(x), n) / np.sqrt(n)


class Rotation:
    def __init__(self, dims: int, seed: int = 42) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sizes = blocks(dims)
        self.order = rng.permutation(dims) if len(self.sizes) > 1 else np.arange(dims)
        self.signs = rng.choice([-1.0, 1.0], dims)

    def _blocks(self, x: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.sizes)
        return np.concatenate([hadamard(x[:, e - n : e]) for n, e in zip(self.sizes, ends, strict=True)], 1)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._blocks(x[:, self.order] * self.signs).astype(np.float32)

    def backward(self, y: np.ndarray) -> np.ndarray:
        out = np.empty_like(y, np.float64)
        out[:, self.order] = self._blocks(y.astype(np.float64)) * self.signs
        return out.astype(np.float32)
