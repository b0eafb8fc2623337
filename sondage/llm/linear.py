"""Linear models on hashed n-grams and dense features: training on the driver over bounded samples, scoring in batches."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

BUCKETS = 1 << 16


@lru_cache(1 << 17)
def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def hashed_chars(text: str, orders: tuple[int, ...] = (3, 4), buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the character n-grams of ``text``."""
    data = text.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(data[i : i + order]) % buckets for order in orders for i in range(len(data) - order + 1)]
    return np.array(found, np.int32)


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Flat buckets and the row of each."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return (np.concatenate(rows) if rows else np.empty(0, np.int32)), np.repeat(np.arange(len(rows)), sizes)


def sums(weights: np.ndarray, flat: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Sum of the weights (buckets x labels) of every row, divided by the root of the row's size."""
    size = np.maximum(1, np.bincount(row, minlength=count))
    out = np.stack([np.bincount(row, weights[flat, k], count) for k in range(weights.shape[1])], 1)
    return out / np.sqrt(size)[:, None]


class LogisticModel:
    """One logistic unit a label over hashed buckets and dense features."""

    def __init__(self, labels: int, dense: int, buckets: int = BUCKETS) -> None:
        self.weights = np.zeros((buckets, labels), np.float32)
        self.dense = np.zeros((dense, labels), np.float32)
        self.bias = np.zeros(labels, np.float32)
        self.center, self.scale = np.zeros(dense), np.ones(dense)

    def logits(self, hashed: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        flat, row = ragged(hashed)
        return sums(self.weights, flat, row, len(hashed)) + ((dense - self.center) / self.scale) @ self.dense + self.bias

    def fit(self, hashed: list[np.ndarray], dense: np.ndarray, target: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> LogisticModel:
        """Full-batch Adagrad on the mean log loss, classes weighted to balance."""
        self.center, self.scale = dense.mean(0), dense.std(0) + 1e-6
        flat, row = ragged(hashed)
        n = len(hashed)
        norm = (1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n))))[row]
        x = (dense - self.center) / self.scale
        weight = np.where(target > 0, 0.5 / np.maximum(1, target.sum(0)), 0.5 / np.maximum(1, (1 - target).sum(0)))
        past = [np.full_like(v, 1e-8) for v in (self.weights, self.dense, self.bias)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.logits(hashed, dense), -30, 30)))
            g = (p - target) * weight
            slopes = [
                np.stack([np.bincount(flat, g[row, k] * norm, len(self.weights)) for k in range(g.shape[1])], 1) + decay * self.weights,
                x.T @ g + decay * self.dense,
                g.sum(0),
            ]
            for value, slope, seen in zip((self.weights, self.dense, self.bias), slopes, past, strict=True):
                seen += slope**2
                value -= (rate * slope / np.sqrt(seen)).astype(np.float32)
        return self
