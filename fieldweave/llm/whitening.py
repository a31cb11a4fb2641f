"""Embedding whitening over exact integer coordinates.

Every entry c of a vector becomes the whole number floor(``scale`` * c) + ``shift``.
The sums S of these numbers are exact, so n*x - S is exact too, and a row is
centred by one division: (n*x - S) / n. A Spark MLlib ``RowMatrix`` over the centred
rows gives the Gramian, which divided by n is the covariance V; partial sums of one
triangle of V meet in a tree, so the driver gets a few of them, whatever the number
of rows. The driver takes V, as large as the square of the vector's length, apart
into eigenvectors by ``eigh``; these are broadcast, and tasks project the rows in
Arrow batches. The covariance of what they made is measured the same way.

Components are numbered from 1 by falling eigenvalue, all rows with the same signs;
each eigenvector's entry of largest magnitude is positive. A component whose variance
is within rounding of zero cannot be whitened and is left out, so constant vectors
or a single row give no rows.

Rows take part if their vector is not null, of the length that most vectors have,
and free of null and non-finite entries and of entries of magnitude 2**30 or more,
whose squares would not fit a long. Repeated rows and rows without an id count and
are returned like others. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import scratch, stage

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**30


def whole(vector: Column, largest: float = LARGEST) -> Column:
    """Whether a vector has entries, all of them finite and smaller than ``largest``."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < largest))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the smaller of two as common; null if there are none."""
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()  # a row a length
    return most["d"] if most else None


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def exact_sums(rows: DataFrame, column: str, dim: int) -> tuple[int, list[int], int]:
    """(rows, sum of each place, largest magnitude) of arrays of whole numbers; a task passes on a row a place."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, most, total = 0, 0, [0] * dim
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy())
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        yield pd.DataFrame({"place": range(dim), "n": n, "most": most, "total": [str(t) for t in total]})

    parts = rows.select(column).mapInPandas(partial, "place int, n long, most long, total string")
    told = parts.groupBy("place").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row a place
    by_place = {r["place"]: r for r in told}
    return (by_place[0]["n"], [int(by_place[i]["total"]) for i in range(dim)], by_place[0]["most"]) if told else (0, [0] * dim, 0)


def gramian(rows: DataFrame, column: str, n: int, dim: int) -> np.ndarray:
    """Sum over the rows of the outer products of an array column with itself."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return np.asarray(RowMatrix(vectors, n, dim).computeGramianMatrix().toArray()).reshape(dim, dim)


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance in falling order, without those that rounding made, and their eigenvectors as columns."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > len(v) * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    values, vectors = values[real], vectors[:, real]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def deviations(away: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each row of whole numbers, as Python integers where a long could overflow."""
    most = float(np.abs(away).max(initial=0))
    if most * most * away.shape[1] < 2**62:
        return (away * away).sum(1).astype(object)
    return np.array([sum(int(y) ** 2 for y in row) for row in away.tolist()], object)


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, n, deviation decimal, whitened array, explained array, identity_error) of each row that takes part.

    ``whitened`` and ``explained`` have a place for each of the first ``components``
    components; ``deviation`` is the row's sum of squares of n*x - S.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    result = f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>"
    with scratch(spark) as kept:
        usable = rows.select(F.col(key), F.col(vector).alias("_v")).where(whole(F.col("_v")))
        dim = usual_length(usable, "_v")
        fitted = usable.where(F.size("_v") == (dim or 0)).select(F.col(key), integers(F.col("_v"), scale, shift).alias("_x"))
        n, sums, most = exact_sums(fitted, "_x", dim or 1)
        if not n:
            return _told(spark.createDataFrame([], result), key, 0, [], 0.0)
        # n*x - S, in longs while they hold it
        width = "bigint" if 2 * n * max(1, most) < 2**62 else "decimal(38,0)"
        total = F.array(*[F.lit(s).cast(width) for s in sums])
        away = F.zip_with("_x", total, lambda x, s: (x.cast(width) * F.lit(n).cast("bigint") - s).cast(width))
        centred = fitted.select(F.transform(away, lambda y: y.cast("double") / F.lit(float(n))).alias("_y"))
        v = gramian(centred, "_y", n, dim) / n
        values, vectors = components_of(v)
        values, vectors = values[:components], vectors[:, :components]
        told = spark.sparkContext.broadcast((n, sums, most, vectors / np.sqrt(values)))

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from decimal import Decimal

            n, sums, most, turn = told.value
            exact = np.int64 if 2 * n * max(1, most) < 2**62 else object
            s = np.array(sums, exact)
            for batch in batches:
                if len(batch):
                    away = np.stack(batch["_x"].to_numpy()).astype(exact) * n - s
                    white = (away.astype(np.float64) / n) @ turn
                    yield pd.DataFrame({key: batch[key], "deviation": [Decimal(int(d)) for d in deviations(away)], "whitened": list(white)})

        white = stage(fitted.mapInPandas(project, result), "whitened")
        kept.append(white)
        error = _identity_error(white, n, len(values))
        return _told(white, key, n, (values / np.trace(v)).tolist(), error)


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    if not k:
        return 0.0
    mean = white.agg(*[F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()  # one row
    centred = white.select(F.zip_with("whitened", F.array(*[F.lit(m) for m in mean]), lambda w, m: w - m).alias("_w"))
    return float(np.abs(gramian(centred, "_w", n, k) / n - np.eye(k)).max())


def _told(white: DataFrame, key: str, n: int, explained: list[float], error: float) -> DataFrame:
    share = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return white.select(F.col(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame, *, key: str = "vec_id") -> DataFrame:
    """The rows of ``whiten``, one for each component, from 1; ``deviation`` as a long (an error where it does not fit)."""
    long = whitened.select(key, "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("_at", "white"))
    return long.select(key, (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("white").alias("whitened"), F.get("explained", F.col("_at")).alias("explained"), "identity_error")
