"""Embeddings as vectors of longs: what operators 11 and 12 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared

#: Fixed by the contracts: a component c becomes floor(256 * c).
SCALE = 256
#: Components from this size on have no exact products in doubles or longs; their rows take no part.
MOST = float(2**53)


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all of its entries are, finite, and small enough to be whole numbers of doubles."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < MOST), F.lit(False)))
    return vector.isNotNull() & fine


def whole(vector: Column) -> Column:
    """floor(256 * c) of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def padded(rows: DataFrame, name: str = "x") -> tuple[DataFrame, int]:
    """rows whose vectors all have the length of the longest, with zeros at the end, and that length."""
    width = rows.agg(F.max(F.size(name))).first()[0] or 0
    return rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(name)))), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs from a column of lists of one length."""
    return column.flatten().to_numpy().reshape(len(column), width)


def written_rows(rows: DataFrame, name: str) -> DataFrame:
    """rows in the shared folder, over no fewer files than there are cores, as what follows is work on numbers."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return shared.written(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows, name)
