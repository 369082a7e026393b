"""Embedding: the batch contract for pluggable embedders and the deterministic default embedder."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K

Embedder = Callable[[pd.Series], pd.Series]

#: Texts that an embedder is asked for at once: their vectors are what a worker's memory is made of.
TEXTS = 256

_FNV_OFFSET = np.uint32(2166136261)
_FNV_PRIME = np.uint32(16777619)


def _hash_vector(text: str | None, dim: int) -> np.ndarray:
    """Unit vector of hashed character trigrams: NFKC, lower case, blanks removed, each trigram once."""
    folded = unicodedata.normalize("NFKC", text or "").lower()
    codes = np.frombuffer("".join(folded.split()).encode("utf-32-le"), dtype=np.uint32)
    width = min(3, len(codes))
    packed = np.zeros(len(codes) - width + 1, dtype=np.int64)
    for i in range(width):
        packed = (packed << 21) | codes[i : i + len(packed)]
    # sorted by value: which of equal trigrams is kept makes no difference, so no order needs to be carried along
    packed.sort()
    packed = packed[np.diff(packed, prepend=-1) != 0]
    h = np.full(len(packed), _FNV_OFFSET, dtype=np.uint32)
    for i in reversed(range(width)):
        h = (h ^ ((packed >> 21 * i) & 0x1FFFFF).astype(np.uint32)) * _FNV_PRIME
    counts = np.bincount((h % np.uint32(dim)).astype(np.int64), minlength=dim)
    return (counts / (np.sqrt(float((counts * counts).sum())) or 1.0)).astype(np.float32)


def hash_embedder(dim: int = K.EMBEDDING_DIM) -> Embedder:
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_hash_vector(t, dim) for t in texts])

    return embed


def _pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow batches cut to at most ``TEXTS`` rows, so that a worker never holds the vectors of a whole batch."""
    for batch in batches:
        for start in range(0, len(batch), TEXTS):
            yield batch.iloc[start : start + TEXTS].reset_index(drop=True)


def embed_column(texts: Column | str, embedder: Embedder) -> Column:
    """Apply an embedder over pieces of Arrow batches; the reply must answer every input of its piece."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in _pieces(pd.Series(batch.to_pylist(), dtype=object) for batch in batches):
            reply = embedder(piece)
            if len(reply) != len(piece):
                raise ValueError("embedder returned a reply of the wrong length")
            yield _lists(reply)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(texts)


def _lists(vectors: pd.Series) -> pa.Array:
    """Vectors as a list column. Whole float32 rows are put end to end, all else is converted number by number."""
    rows = list(vectors)
    if rows and all(isinstance(v, np.ndarray) and v.dtype == np.float32 and v.ndim == 1 for v in rows):
        flat = np.concatenate(rows)
        if not np.isnan(flat).any():
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    given = pd.Series([list(v) if isinstance(v, np.ndarray) else v for v in rows], dtype=object)
    return pa.Array.from_pandas(given, type=pa.list_(pa.float32()), safe=False)


def try_embed_column(texts: Column | str, embedder: Embedder) -> Column:
    """``struct<vector, failed>``: a piece that the embedder refuses is asked again text by text, so one bad text fails alone."""

    def answers(batch: pd.Series) -> list:
        reply = embedder(batch)
        if len(reply) != len(batch):
            raise ValueError("embedder returned a reply of the wrong length")
        return list(reply)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            try:
                vectors = answers(piece)
            except Exception:  # noqa: BLE001  whatever a model raises is a failed attempt
                vectors = []
                for i in range(len(piece)):
                    try:
                        vectors += answers(piece.iloc[i : i + 1])
                    except Exception:  # noqa: BLE001
                        vectors.append(None)
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "failed": [v is None for v in vectors]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "vector array<float>, failed boolean")(texts)


def vector_is_usable(vector: Column | str, dim: int) -> Column:
    """Exact width and only finite numbers; null counts as unusable."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def match_replies(requests: DataFrame, replies: DataFrame, dim: int) -> DataFrame:
    """Check embedder replies against the requests of their batch and put them back in input order.

    requests: ``batch_id, index, text``; replies: ``batch_id, index, embedding``. A batch is accepted
    as a whole: the counts agree, each index is within range and used once, every vector has the exact
    width and finite numbers. Result: ``batch_id, index, text, embedding, accepted``.
    """
    asked = requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("asked"))
    usable = (F.col("index") >= 0) & vector_is_usable("embedding", dim)
    given = (
        # one row per index first, so that a batch is checked without a distinct aggregate
        replies.groupBy("batch_id", "index")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_and(F.coalesce(usable, F.lit(False))).alias("good"),
            F.first("embedding").alias("embedding"),
        )
    )
    verdict = (
        given.groupBy("batch_id")
        .agg(
            F.sum("n").alias("given"),
            F.max("n").alias("most"),
            F.bool_and("good").alias("good"),
            F.max("index").alias("last"),
        )
        .join(asked, "batch_id", "right")
        .select(
            "batch_id",
            F.coalesce(
                (F.col("given") == F.col("asked"))
                & (F.col("most") == 1)
                & F.col("good")
                & (F.col("last") == F.col("asked") - 1),
                F.lit(False),
            ).alias("accepted"),
        )
    )
    return (
        requests.join(given.select("batch_id", "index", "embedding"), ["batch_id", "index"], "left")
        .join(verdict, "batch_id")
        .withColumn("embedding", F.when(F.col("accepted"), F.col("embedding")))
    )
