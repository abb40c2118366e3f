"""Whitening of embeddings with distributed block matrices.

Components of a vector become whole numbers, floor(scale * c), held at the ends of a long. The fit list holds each distinct
vector once. Its centred rows, numbered without gaps, are laid into the blocks of a distributed
BlockMatrix; the transpose times the matrix is the scatter matrix, which has the size of a vector
squared and is decomposed on the driver. The whitening matrix (eigenvectors by falling
eigenvalue, each over the root of its eigenvalue) is a BlockMatrix of one block; all rows, centred
alike, are multiplied by it.

The transpose product is cut in its middle dimension, a part for each block of rows: parts are
multiplied where they lie and small products are summed, so no task sees more than a block. A
block has `block_rows` rows. Sums, counts and deviations are exact whole numbers. A vector that a
third of the rows share is summed within tasks before it is shuffled, and rows meet their products by
number, so there is no hot key.

Rows whose vector is null or empty, or holds a null or a number that is not finite, are dropped. Rows
with a null id stay, with a null id. Rows that repeat an id or a row each have their result. Vectors
of different lengths have no covariance and are refused (ValueError). A component without variance
cannot be whitened: its `whitened` is null. Where no component has variance, `explained` and
`identity_error` are null too. An empty table, or one without a usable vector, gives an empty result.
Vectors of fewer numbers than components have as many components as numbers. Other columns of the
input, whatever their names, play no part. A deviation beyond a long is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import cut_points, durable

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 8192
RESULT = ("`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")
# Eigenvalues up to so many parts of the largest one are rounding.
ROUNDING = 1e-12


class Fit(NamedTuple):
    """Count, sums, and the eigenvalues (falling) and eigenvectors (columns) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def whitening(self, components: int) -> np.ndarray:
        """Columns that whiten centred rows; zero where a component has no variance."""
        kept = self.values[:components]
        scale = np.zeros(len(kept))
        scale[self.has_variance(components)] = 1 / np.sqrt(kept[self.has_variance(components)])
        return self.vectors[:, :components] * scale

    def has_variance(self, components: int) -> np.ndarray:
        return self.values[:components] > ROUNDING * max(self.values[0], 0.0)


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x: array of long) of the rows with a usable vector."""
    cells = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(key).alias("key"), cells.alias("cells")).where(F.size("cells") > 0).where(good)
    return kept.select("key", F.transform("cells", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _placed(df: DataFrame) -> DataFrame:
    """With the number of the task that made a row, and the row's place in it; write the result at once."""
    made = F.monotonically_increasing_id()
    return df.withColumns({"part": F.shiftright(made, 33), "place": made.bitwiseAND(F.lit((1 << 33) - 1))})


def _numbered(df: DataFrame) -> DataFrame:
    """`index`, without gaps, instead of the written `part` and `place`. The driver sees a count for
    each part."""
    counts = sorted(df.groupBy("part").count().collect())
    starts, at = [], 0
    for part, count in counts:
        starts.append((part, at))
        at += count
    table = df.sparkSession.createDataFrame(starts, "part long, start long")
    return df.join(F.broadcast(table), "part").withColumn(
        "index", F.col("start") + F.col("place")).drop("part", "place", "start")


def _sums(fit: DataFrame) -> tuple[int, list[int], int, int]:
    """Count, sums by position, least and greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, values = batch.column(0).value_lengths().to_numpy(), batch.column(0).flatten().to_numpy()
            if not len(size) or len(set(size)) > 1:  # vectors of several lengths are refused below
                continue
            # Sums beyond a long are taken as whole numbers of any size.
            wide = int(np.abs(values.astype(float)).max()) * len(size) >= 2 ** 62
            total = (values.astype(object) if wide else values).reshape(len(size), -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([int(v) for v in total], pa.decimal128(38, 0))],
                ["position", "total"])

    lengths = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"),
                      F.max(F.size("x")).alias("most")).first()
    totals = fit.select("x").mapInArrow(run, "position int, total decimal(38,0)").groupBy("position").agg(
        F.sum("total").alias("total")).collect()
    return lengths.n, [int(r.total) for r in sorted(totals)], lengths.least, lengths.most


def _matrix(rows: DataFrame, fit_n: int, sums: list[int], block_rows: int) -> BlockMatrix:
    """The centred rows (index, x) as blocks of `block_rows` rows and all columns."""
    means = F.array(*[F.lit(s / fit_n) for s in sums])
    centred = rows.select("index", array_to_vector(F.zip_with(
        "x", means, lambda a, b: a.cast("double") - b)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"),
                            rows.count(), len(sums)).toBlockMatrix(block_rows, len(sums))


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, its middle dimension cut at every block of rows."""
    java, cut = matrix.transpose()._java_matrix_wrapper, matrix.numRowBlocks
    product = java.call("multiply", matrix._java_matrix_wrapper._java_model, max(cut, 1))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _projected(spark: SparkSession, matrix: BlockMatrix, columns: np.ndarray) -> DataFrame:
    """(index, z: array of double): rows of the product with a local matrix of few columns."""
    block = DenseMatrix(*columns.shape, columns.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *columns.shape)
    product = matrix.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select(F.col("index").cast("long").alias("index"), vector_to_array("vector").alias("z"))


def _fitted(fit: DataFrame, block_rows: int) -> tuple[Fit, BlockMatrix] | None:
    """The fit over written distinct vectors (index, x), and their block matrix."""
    n, sums, least, most = _sums(fit)
    if not n:
        return None
    if least != most:
        raise ValueError(f"vectors have {least} to {most} numbers; whitening needs one length")
    matrix = _matrix(fit, n, sums, block_rows)
    values, vectors = np.linalg.eigh(_scatter(matrix) / n)
    return Fit(n, sums, values[::-1], vectors[:, ::-1]), matrix


def _identity_error(rows: DataFrame, found: np.ndarray) -> float | None:
    """Largest entry of the covariance of `z` minus the identity, over components with variance."""
    kept = np.flatnonzero(found).tolist()
    gaps = [F.abs(F.covar_pop(F.col("z")[i], F.col("z")[j]) - F.lit(float(i == j))).alias(f"{i}_{j}")
            for i in kept for j in kept if i <= j]
    return max(rows.agg(*gaps).first()) if gaps else None


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each usable row and each of the first components: key, `component` (from 1), `n` (distinct
    vectors), `deviation` (sum of (n * x - sum)^2), `whitened`, `explained` (share of the variance)
    and `identity_error` (how far the whitened fit list is from unit covariance)."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    with cut_points(spark) as cut:
        usable = cut(_placed(whole_vectors(rows, key, vector, scale)))
        distinct = cut(_placed(usable.select("x").distinct()))
        fitted = _fitted(cut(_numbered(distinct)), block_rows)
        if fitted is None:
            return spark.createDataFrame([], RESULT.format(key=key, kind=kind.simpleString()))
        fit, matrix = fitted
        columns, found = fit.whitening(components), fit.has_variance(components)
        error = _identity_error(cut(_projected(spark, matrix, columns)), found)
        numbered = cut(_numbered(usable))
        z = _projected(spark, _matrix(numbered, fit.n, fit.sums, block_rows), columns)
        total = float(np.maximum(fit.values, 0).sum())
        off = F.zip_with("x", F.array(*[F.lit(s) for s in fit.sums]),
                         lambda a, b: F.lit(fit.n).cast("long") * a - b.cast("long"))
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda sum, d: sum + d * d)
        each = F.explode(F.array(*[F.struct(
            F.lit(k + 1).alias("component"),
            (F.col("z")[k] if ok else F.lit(None).cast("double")).alias("whitened"),
            F.lit(max(fit.values[k], 0.0) / total if total > 0 else None).cast("double").alias("explained"))
            for k, ok in enumerate(found)]))
        out = numbered.select("index", "key", deviation.alias("deviation")).join(z, "index")
        return durable(out.select("key", "deviation", each.alias("each")).select(
            F.col("key").alias(key), "each.component", F.lit(fit.n).cast("long").alias("n"), "deviation",
            "each.whitened", "each.explained", F.lit(error).cast("double").alias("identity_error")))


