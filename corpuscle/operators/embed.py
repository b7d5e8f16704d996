"""Texts to vectors through a pluggable encoder, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 510  # tokens of a text that an encoder sees
BATCH = 32


class Letters:
    """An encoder without a model, for tests and offline use: a text's tokens are its Latin letters, its vector their counts."""

    def tokenize(self, text: str) -> list[int]:
        return [ord(c) - 97 for c in text.lower() if "a" <= c <= "z"]

    def run(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(text, 26): ids and mask are (text, token) matrices, filled up to the longest text of the batch."""
        out = np.zeros((len(ids), 26))
        np.add.at(out, (np.repeat(np.arange(len(ids)), mask.sum(1)), ids[mask.astype(bool)]), 1.0)
        return out


def encode(model, texts: list[str], limit: int = LIMIT) -> np.ndarray:
    """Vectors of length one (a zero vector stays): tokens beyond `limit` are cut, of a matrix a text the first row counts."""
    tokens = [model.tokenize(t or "")[:limit] for t in texts]
    width = max(map(len, tokens), default=0)
    ids = np.array([t + [0] * (width - len(t)) for t in tokens], np.int64).reshape(len(tokens), width)
    mask = np.array([[1] * len(t) + [0] * (width - len(t)) for t in tokens], np.int64).reshape(len(tokens), width)
    out = np.asarray(model.run(ids, mask), float)
    if out.ndim == 3:
        out = out[:, 0]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embedder(load: Callable[[], object] = Letters, limit: int = LIMIT, batch: int = BATCH) -> Callable[[Column], Column]:
    """A Column function text -> array<double>; `load` makes the encoder once a worker.  A null text is the empty one."""
    held: dict[str, object] = {}

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        model = held.setdefault("model", load())
        rows = texts.tolist()
        return pd.Series([v.tolist() for i in range(0, len(rows), batch) for v in encode(model, rows[i : i + batch], limit)], dtype=object)

    return run


class EmbeddingFunction:
    """The same encoder for lists of texts, with a name, as vector stores call it: once to write and once to ask."""

    def __init__(self, name: str, load: Callable[[], object] = Letters, limit: int = LIMIT) -> None:
        self._name, self._load, self._limit, self._model = name, load, limit, None

    def name(self) -> str:
        return self._name

    def __call__(self, input: list[str]) -> list[list[float]]:  # noqa: A002
        if self._model is None:
            self._model = self._load()
        return encode(self._model, input, self._limit).tolist()

    embed_query = __call__
