"""Checks and packing of embedding columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved


def usable(vec: Column) -> Column:
    """True for a vector with a non-zero component and no null or non-finite one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep) per usable row and (rep, vec, n) per distinct vector.

    ``rep`` is the least id that holds the vector: equal vectors are compared once, however many
    rows hold them.
    """
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 as 0.0
    good = rows.where(usable(F.col(vec_col).cast("array<double>"))).select(F.col(id_col).alias("vec_id"), vec.alias("vec"))
    classes = saved(good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    repeated = classes.where("n > 1")
    members = good.join(repeated, "vec", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
    return saved(members), classes


def matrix(column, dim: int | None = None) -> np.ndarray:
    """Rows of a list<double> Arrow column as a matrix; all must have one length."""
    flat = np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1 if dim is None else dim) if len(column) else np.zeros((0, dim or 0))
