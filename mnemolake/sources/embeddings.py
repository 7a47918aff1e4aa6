"""Embedding texts: encoders, and a cache that is a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HashEncoder:
    """Deterministic unit vectors drawn from a text's SHA-256: offline, equal texts only are near."""

    name = "hash"

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(self.dim, dtype=np.float32) for t in texts]
        m = np.stack(rows) if rows else np.zeros((0, self.dim), np.float32)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class WordHashEncoder(HashEncoder):
    """Sums of hashed words, so that texts that share words are near."""

    name = "words"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(rows: DataFrame, encoder: HashEncoder, key: str = "id", text: str = "text", batch: int = 128) -> DataFrame:
    """(key, embedding) of texts, encoded by Arrow batches on executors."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t or "" for t in pdf[text]]
            parts = [encoder.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.DataFrame({key: pdf[key], "embedding": list(np.concatenate(parts)) if parts else []})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def incremental(rows: DataFrame, cache: DataFrame | None, encoder: HashEncoder, key: str = "id", text: str = "text") -> DataFrame:
    """(key, hash, embedding): cached vectors where the text's hash is unchanged, others encoded anew.

    Rows no longer there fall out of the cache, so it follows the table.
    """
    hashed = rows.select(key, text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))
    if cache is None:
        missing, held = hashed, None
    else:
        held = hashed.join(cache.select(key, "hash", "embedding"), [key, "hash"]).select(key, "hash", "embedding")
        missing = hashed.join(cache.select(key, "hash"), [key, "hash"], "left_anti")
    fresh = encode(missing, encoder, key, text).join(missing.select(key, "hash"), key).select(key, "hash", "embedding")
    return fresh if held is None else held.unionByName(fresh)


def completions(rows: DataFrame, call: Callable[[str], str] | None, prompt: str = "prompt", key: str = "id", attempts: int = 3) -> DataFrame:
    """(key, completion, error) from an injected text model; without one every row says that completions are disabled."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, p in zip(pdf[key], pdf[prompt], strict=True):
                done, error = None, "completions are disabled" if call is None else None
                for _ in range(attempts if call else 0):
                    try:
                        done, error = call(p), None
                        break
                    except Exception as x:  # an external model may fail in any way; the row says how
                        error = str(x)
                out.append((k, done, error))
            yield pd.DataFrame(out, columns=[key, "completion", "error"])

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, completion string, error string")
