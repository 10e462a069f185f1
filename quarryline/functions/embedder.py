"""Turning texts into vectors: a seam for models, and a hashing stand-in that needs none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[list[str]], np.ndarray]


def hashing_model(dims: int = 64) -> Model:
    """Unit vectors of hashed words; a stand-in for tests, not a semantic model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed_texts(texts: DataFrame, model: Model, batch: int = 128) -> DataFrame:
    """texts (hash, text) as (hash, embedding), in batches; a model that answers with another number of vectors is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["hash", "embedding"])

    return texts.select("hash", "text").mapInArrow(run, "hash string, embedding array<float>")


def embed_missing(texts: DataFrame, cache: DataFrame, model: Model, name: str, batch: int = 128) -> tuple[DataFrame, DataFrame]:
    """texts (pos, hash, text) with their embeddings, and the cache with the new ones: each different text that the cache
    lacks is embedded once."""
    from quarryline.operators.store import misses
    from quarryline.sources.tables import cut
    from pyspark.sql import functions as F

    new = cut(embed_texts(misses(texts, cache, name), model, batch))
    grown = cache.unionByName(new.select(F.col("hash").alias("text_hash"), F.lit(name).alias("model"), "embedding"))
    have = grown.where(F.col("model") == name).select(F.col("text_hash").alias("hash"), "embedding")
    return texts.join(have, "hash"), grown
