"""Vector functions on arrays: similarity, norms, binarisation, pooling, hashing embeddings and linear heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from memlayer.functions.hashing import fnv1a_bucket, fnv1a_int
from memlayer.functions.text import column, raw_tokens


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """L2 norm (AGG8)."""
    return F.sqrt(F.aggregate(column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 for empty vectors, other sizes or a zero norm (RET4)."""
    a, b = column(a), column(b)
    length = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def binarized(a: Column | str) -> Column:
    """Signs: 1, -1 or 0 (EMB2, SF18)."""
    return F.transform(column(a), lambda x: F.signum(x.cast("double")))


def normalized(a: Column | str) -> Column:
    """A vector over its norm; a zero vector stays."""
    a = column(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def softmax(a: Column | str) -> Column:
    """Probabilities, stabilised by the maximum (AGG11); maximum and sum are taken once."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    parts = once(F.array_max(column(a)), lambda top: F.transform(column(a), lambda x: F.exp(x - top)))
    return once(parts, lambda p: once(F.aggregate(p, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(p, lambda x: x / total)))


def mean_pooled(rows: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0 (AGG9); zeros if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    zero = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept))).otherwise(zero)


def hash_buckets(text: Column | str, dim: int = 64) -> Column:
    return F.transform(raw_tokens(text), lambda t: fnv1a_bucket(t, dim))


def hash_weights(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``(id, bucket, weight)``: the non-zero components of each text's hashing embedding (EMB1)."""
    return hash_embedding(df, id_col, text_col, dim).select("id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``(id, embedding)``, dense and of norm 1; a text without tokens has the zero vector (EMB1).

    No shuffle: Spark splits the text, and one Arrow batch at a time its tokens are hashed, each kind once, and counted.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(raw_tokens(text_col), F.array().cast("array<string>")).alias("t"))
    schema = StructType([StructField("id", rows.schema["id"].dataType)]).add("embedding", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            cells = hashed_rows(tokens, dim).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * dim, cells)], names=["id", "embedding"])

    return rows.mapInArrow(run, schema)


def hashed_rows(tokens: pa.Array, dim: int = 64) -> np.ndarray:
    """The hashing embeddings of some token lists, a row each."""
    coded = tokens.flatten().dictionary_encode()
    bucket = np.array([fnv1a_int(t.encode("utf-8", "surrogatepass")) % dim for t in coded.dictionary.to_pylist()], np.int64)
    place = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())
    counts = np.bincount(place * dim + bucket[coded.indices.to_numpy()] if len(place) else place, minlength=len(tokens) * dim).reshape(-1, dim).astype(float)
    length = np.sqrt(np.square(counts).sum(axis=1, keepdims=True))
    return counts / np.where(length > 0, length, 1)


def head_argmax(vector: Column | str, weights: list[list[float]], bias: list[float]) -> Column:
    """The row of a linear head with the greatest score; of equal rows the first (AGG10)."""
    scores = F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in row])) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)])
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1
