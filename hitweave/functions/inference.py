"""Feed-forward networks applied to Arrow batches, and a distributed linear fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0.0),
    "tanh": np.tanh,
    "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    "silu": lambda x: x / (1.0 + np.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1.0 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
}


@dataclass(frozen=True)
class Mlp:
    """Weights (in, out) and biases per layer; hidden layers may be normalised."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    hidden: str = "relu"
    output: str | None = None
    layer_norm: bool = False

    def __post_init__(self):
        if sum(w.size + b.size for w, b in self.layers) > 50_000_000:
            raise ValueError("network too large to send to every task")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            last = i == len(self.layers) - 1
            name = self.output if last else self.hidden
            if name is None:
                continue
            if self.layer_norm:
                x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
            x = ACTIVATIONS[name](x)
        return x


def random_mlp(sizes: list[int], seed: int = 0, **options) -> Mlp:
    rng = np.random.default_rng(seed)
    layers = tuple((rng.normal(0, n**-0.5, (n, m)), np.zeros(m)) for n, m in zip(sizes[:-1], sizes[1:]))
    return Mlp(layers, **options)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))


def embed_udf(network: Mlp):
    """Arrow UDF: vector -> vector."""

    @F.pandas_udf("array<double>")
    def embed(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(network(_matrix(vectors))) if len(vectors) else [], dtype=object)

    return embed


def score_udf(network: Mlp):
    """Arrow UDF: vector -> raw output of a one-column network."""

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(network(_matrix(vectors))[:, 0] if len(vectors) else [], dtype=float)

    return score
