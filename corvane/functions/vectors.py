"""Column functions over vectors, and the hashed bag-of-words embedding, sparse and dense."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.session import ship

DIMENSIONS = 768
#: Texts that are embedded at once.
EMBED_BATCH = 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the norms is under 1e-9."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms < 1e-9, F.lit(0.0)).otherwise(dot(a, b) / norms)


def hash_slot(word: Column, dimensions: int = DIMENSIONS) -> tuple[Column, Column]:
    """(index, sign) from a word's md5 taken as one number, by remainders of its 32-bit pieces."""
    digest, rest = F.md5(word), F.lit(0).cast("long")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        rest = (rest * (1 << 32) + piece) % (2 * dimensions)
    return (rest % dimensions).cast("int"), F.when(rest < dimensions, 1).otherwise(-1)


#: Words whose slots a worker keeps, by number of dimensions: beyond so many it begins anew.
MOST_SLOTS = 200_000
_SLOTS: dict[int, dict[str, int]] = {}
_SPACE = re.compile(r"[ \t\r\n]+")


def embed_texts(texts: Iterable[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row a text: signed counts of its lower-cased words by hash, normalised where the norm exceeds 1e-6; null is empty."""
    slots, out = _SLOTS.setdefault(dimensions, {}), []
    for text in texts:
        words = [w for w in _SPACE.split((text or "").lower()) if w]
        if len(slots) > MOST_SLOTS:
            slots.clear()
        for w in {w for w in words if w not in slots}:
            slots[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest(), "big") % (2 * dimensions)
        both = np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=2 * dimensions)
        out.append(both[:dimensions] - both[dimensions:])
    v = np.array(out, np.float64).reshape(-1, dimensions)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 1e-6, norm, 1.0)


def _sparse_batches(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, EMBED_BATCH):
            part = b.slice(k, EMBED_BATCH)
            v = embed_texts(part.column(1).to_pylist(), dimensions)
            row, idx = np.nonzero(v)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(idx.astype(np.int32)), pa.array(v[row, idx])], names=["id", "idx", "val"])


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse rows (id, idx, val), normalised where the norm exceeds 1e-6. A text is read whole, in its own task: nothing moves."""
    ship(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([src.schema["id"], *StructType.fromDDL("idx int, val double").fields])
    return src.mapInArrow(lambda it: _sparse_batches(it, dimensions), schema).withColumnRenamed("id", id_col)


def _dense_batches(batches: Iterator[pa.RecordBatch], embed: Callable[[list], object], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            v = [np.asarray(x, np.float32) for x in embed(part.column(part.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(v, pa.list_(pa.float32()))], names=[*part.schema.names[:-1], "embedding"])


def with_embedding(df: DataFrame, text: Column, embed: Callable[[list], object] = embed_texts, size: int = EMBED_BATCH) -> DataFrame:
    """df with ``embedding``, made by ``embed`` of ``size`` texts at a time, as a model's service takes them."""
    ship(df.sparkSession)
    src = df.withColumn("embedding", text)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("embedding array<float>").fields])
    return src.mapInArrow(lambda it: _dense_batches(it, embed, size), schema)
