"""Models outside the engine (embedding, OCR, captions, drafting) as functions handed batches; without one a stub that
depends on the input alone stands in, so that plans can be run and tested."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def text_hook(model: Callable[[list], list] | None = None, stub: str = "text"):
    """A Column function from input to text; the model loads once in each worker, when first called."""

    @F.pandas_udf("string")
    def call(x: pd.Series) -> pd.Series:
        values = x.tolist()
        return pd.Series(model(values) if model else [None if v is None else f"{stub}:{hashlib.md5(v if isinstance(v, bytes) else str(v).encode()).hexdigest()[:8]}" for v in values], dtype=object)

    return call


def embedding_hook(model: Callable[[list], list] | None = None, dim: int = 8):
    """A Column function from text to a vector; empty texts get zeros."""

    def stub(v: str) -> list[float]:
        if not v:
            return [0.0] * dim
        raw = hashlib.sha256(v.encode()).digest()
        return [raw[i % 32] / 255 - 0.5 for i in range(dim)]

    @F.pandas_udf("array<float>")
    def call(x: pd.Series) -> pd.Series:
        values = x.fillna("").tolist()
        return pd.Series(model(values) if model else [stub(v) for v in values])

    return call
