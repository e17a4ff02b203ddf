"""Whitening of embeddings: components by MLlib's singular value decomposition of the centred distributed rows.

The rows are integers, so sums are exact, and a row's deviation from the mean, times the number of rows, is an integer too. Singular
values s of the centred fit list give eigenvalues s^2 / n of its covariance; the total variance does not come from them but from the
exact deviations. All components are asked for: then MLlib decomposes the Gram matrix by LAPACK, to double precision, and not by an
iteration that stops at a tolerance. That matrix, of the vectors' length squared, and the components are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import discard, materialise, ship

SCALE, COMPONENTS = 256, 4
#: Singular values under this share of the greatest are none: their components are not given.
LEAST = 1e-9


def integers(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x): floor(256 * c) of every entry; rows with a null vector, or null or non-finite entries, go."""
    c = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    held = df.select(F.col(f"`{id_col}`").alias("vec_id"), c.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return held.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; Python's integers where 64 bits might not hold its square's sum."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * most * most < 2**63:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _batches(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.asarray(b.column(1).flatten(), np.int64).reshape(b.num_rows, len(sums))
        d = _deviations(x, n, sums)
        whole = [v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]
        w = (d / n).astype(np.float64) @ axes
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])


def _white(rows: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> DataFrame:
    """rows: vec_id, x. (vec_id, deviation, w): axes are the components over the roots of their eigenvalues, a column each."""
    return rows.select("vec_id", "x").mapInArrow(lambda it: _batches(it, n, sums, axes), "vec_id bigint, deviation bigint, w array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row a row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    df: an id (long) and a vector; other columns are not read. Null vectors and those with null or non-finite entries go, as do
    empty ones and those of another length than most (of lengths equally common the smallest); zero vectors stay. Repeated rows,
    null and repeated ids each give their rows; the fit list holds a vector once. Components with no variance are not given: none
    where all vectors are equal or there is one only, nor for an empty table. A deviation beyond 64 bits is null.
    """
    spark = df.sparkSession
    ship(spark)
    every = integers(df, id_col, vector)
    sizes = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if sizes is None:
        return empty
    every = every.filter(F.size("x") == sizes.d)
    fit_list = materialise(every.select("x").distinct(), "fit-list")
    head = fit_list.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(sizes.d)]).first()
    n, sums = head.n, np.array([int(v) for v in head[1:]])
    if n < 2:
        return empty
    means = F.lit([float(s / n) for s in sums.tolist()])
    centred = fit_list.select(array_to_vector(F.zip_with("x", means, lambda x, m: x.cast("double") - m)).alias("row"))
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), numRows=n, numCols=sizes.d)
    svd = rows.computeSVD(sizes.d, computeU=False, rCond=LEAST)
    eigenvalues = np.asarray(svd.s.toArray()) ** 2 / n
    most = min(components, len(eigenvalues))
    eigenvalues, axes = eigenvalues[:most], svd.V.toArray()[:, :most] / np.sqrt(eigenvalues[:most])
    fitted = _white(fit_list.withColumn("vec_id", F.lit(0).cast("long")), n, sums, axes)
    squares = F.aggregate(F.zip_with("x", F.lit(sums.tolist()), lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s).cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda t, y: (t + y * y).cast("decimal(38,0)"))
    total = fit_list.agg(F.sum(squares)).first()[0]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    found = fitted.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()  # both are centred before they are multiplied
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    variance = int(total) / n**3
    discard(fit_list)
    told = _white(every, n, sums, axes).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.lit([float(e / variance) for e in eigenvalues])
    return told.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
