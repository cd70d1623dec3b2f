"""Dense encoders. An encoder is a picklable factory of ``list[str] -> 2-d float array``."""

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]


class HashedWords:
    """Built-in stand-in for a sentence model: signed word hashing to unit vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashed_words_{dim}"

    def __call__(self) -> Encode:
        return self.encode

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                out[row, code // 2 % self.dim] += 1.0 if code % 2 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def encoder_name(encoder: Callable) -> str:
    """What tells an encoder from others in stores and records."""
    name = getattr(encoder, "name", None)
    if isinstance(name, str):
        return name
    kind = encoder if hasattr(encoder, "__qualname__") else type(encoder)
    held = sorted((key, str(value)) for key, value in getattr(encoder, "__dict__", {}).items())
    return f"{kind.__module__}.{kind.__qualname__}{held or ''}"


def encoded(text: Column, encoder: Callable[[], Encode], batch_size: int = 256) -> Column:
    """Vectors of texts; each Python worker loads the encoder once and feeds it batches."""

    @F.pandas_udf("array<double>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in series:
            parts = [model(texts.iloc[i:i + batch_size].tolist())
                     for i in range(0, len(texts), batch_size)]
            rows = np.concatenate([np.asarray(p, dtype=float) for p in parts]) if parts else []
            yield pd.Series(list(rows), index=texts.index)

    return encode(text)


def encode_texts(units: DataFrame, encoder: Callable[[], Encode],
                 batch_size: int = 256) -> DataFrame:
    """Adds ``vec`` to a frame of texts."""
    return units.withColumn("vec", encoded(F.col("text"), encoder, batch_size)).drop("text")
