"""Embedders: the protocol, a deterministic one in Spark expressions, one that asks a service over HTTP, and pooling for models that give token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import vec
from engram.llm_api import post_json, with_retries

CHUNK = 256


class Embedder(Protocol):
    dimensions: int

    def embed_batch(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def hash_embedding(text: Column, dimensions: int = 384) -> Column:
    """Unit vector of hashes: the same for equal texts, unrelated otherwise."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.xxhash64(text, i).cast("double") / float(2**63))
    return vec.normalize(raw)


def with_embeddings(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Embeddings by a model, one a task, in chunks of 256 texts."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {out} array<double>"

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            found = []
            for at in range(0, len(texts), CHUNK):
                found += [normalize_np(np.asarray(v, dtype=np.float64)).tolist() for v in embedder.embed_batch(texts[at : at + CHUNK])]
            pdf[out] = found
            yield pdf

    return df.mapInPandas(run, schema)


@dataclass
class HttpEmbedder:
    """A service that embeds texts over HTTP. `post` sends a body and returns the parsed answer."""

    url: str
    model: str
    dimensions: int
    headers: dict[str, str] = field(default_factory=dict)
    post: Callable[[str, dict[str, str], dict], dict] = post_json

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        answer = with_retries(lambda: self.post(self.url, self.headers, {"model": self.model, "input": list(texts)}))
        found = [r["embedding"] for r in sorted(answer["data"], key=lambda r: r.get("index", 0))]
        if len(found) != len(texts) or any(len(v) != self.dimensions for v in found):
            raise ValueError(f"the service gave {len(found)} vectors for {len(texts)} texts, or of another length than {self.dimensions}")
        return found


def normalize_np(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def pool(tokens: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One unit vector a text from token vectors (texts x tokens x dimensions): mean over the mask, the first, or none (the model's own)."""
    if how == "none":
        out = tokens
    elif how == "cls":
        out = tokens[:, 0]
    else:
        m = mask[:, :, None].astype(tokens.dtype)
        out = (tokens * m).sum(axis=1) / np.maximum(1e-9, m.sum(axis=1))
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))
