"""Embeddings: a hashing bag-of-words provider, and the interface for others.

A provider is a function from a DataFrame (key, text) to (key, vector). Providers that need
model weights or a network are named here and raise ProviderUnavailable; ``provided`` makes
one of any function from a list of texts to a list of vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import text as X

# Dimension; a token's bucket is its digest's first four bytes modulo the
# dimension, its sign the next byte's lowest bit (1: plus).
DIMENSION = 512
#: Digests of tokens: blake2b of eight bytes is the one that vectors are made with.
FAMILIES = {"blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(), "sha256": lambda b: hashlib.sha256(b).digest()}
_STOP, _TOKENS = frozenset(X.EMBEDDING_STOP), re.compile(X.EMBEDDING_TOKEN)


class ProviderUnavailable(RuntimeError):
    """The provider's weights, engine or service cannot be reached from here."""


def _terms(family: str, dimension: int) -> Callable[[str | None], dict[int, float]]:
    """Function from a text to its buckets and their signed counts, dampened by log1p."""
    digest, stop, find, places = FAMILIES[family], _STOP, _TOKENS.findall, {}

    def place(token: str) -> tuple[int, int]:
        d = digest(token.encode())
        return int.from_bytes(d[:4], "big") % dimension, 1 if d[4] & 1 else -1

    def run(text: str | None) -> dict[int, float]:
        sums: dict[int, int] = {}
        for t in find((text or "").lower()):
            if t not in stop:
                if (at := places.get(t)) is None:
                    if len(places) > 100_000:
                        places.clear()
                    at = places[t] = place(t)
                sums[at[0]] = sums.get(at[0], 0) + at[1]
        return {b: float(np.copysign(np.log1p(abs(v)), v)) for b, v in sums.items() if v}

    return run


def hashed_terms(rows: DataFrame, key: str, dimension: int = DIMENSION, family: str = "blake2b") -> DataFrame:
    """key, terms: an array of (bucket, value), made within the row; nothing is shuffled."""
    kind = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("value", T.DoubleType())]))
    schema = T.StructType([rows.schema[key], T.StructField("terms", kind)])
    item = pa.list_(pa.struct([("bucket", pa.int32()), ("value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _terms(family, dimension)
        for b in batches:
            found = [[{"bucket": k, "value": v} for k, v in sorted(made(t.as_py()).items())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], names=schema.names)

    return rows.select(key, "text").mapInArrow(run, schema)


def provided(rows: DataFrame, key: str, embed: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """key, vector by any function that embeds a list of texts; embed() is called once a
    task and gives it, so a model is loaded once a task."""
    schema = T.StructType([rows.schema[key], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = embed()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(make(b.column(1).to_pylist()), pa.list_(pa.float32()))], names=schema.names)

    return rows.select(key, "text").mapInArrow(run, schema)


def hashing_embedding(rows: DataFrame, key: str, dimension: int = DIMENSION, family: str = "blake2b") -> DataFrame:
    """key, vector (unit length; zero for a text without tokens)."""

    def embed():
        made = _terms(family, dimension)

        def each(text: str | None) -> np.ndarray:
            vector = np.zeros(dimension)
            for bucket, value in made(text).items():
                vector[bucket] = value
            size = np.sqrt((vector * vector).sum())
            return (vector / size if size else vector).astype(np.float32)

        return lambda texts: [each(t) for t in texts]

    return provided(rows, key, embed)


def local_model(rows: DataFrame, key: str) -> DataFrame:
    raise ProviderUnavailable("the local sentence model's weights are not installed")


def hosted_model(rows: DataFrame, key: str) -> DataFrame:
    raise ProviderUnavailable("the hosted embedding service cannot be reached")


PROVIDERS = {"hashing": hashing_embedding, "local": local_model, "hosted": hosted_model}
