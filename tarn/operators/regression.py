"""Ordinary least squares in closed form: one distributed aggregate, one small solve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SingularError(ValueError):
    """The normal equations have no unique solution."""


def gram(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows, from one aggregate with map-side partial sums; rows with nulls are left out."""
    names = [*features, target]
    for n in names:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise ValueError(f"column {n} is not numeric")
    d = len(features)
    cols = [F.col(f"`{n}`").cast("double") for n in names]
    pairs = [(i, j) for i in range(d) for j in range(i, d + 1)]
    row = df.select(*(c.alias(f"x{i}") for i, c in enumerate(cols))).dropna().agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs)).first()
    xx, xy = np.zeros((d, d)), np.zeros(d)
    for i, j in pairs:
        value = row[f"s{i}_{j}"] or 0.0
        if j == d:
            xy[i] = value
        else:
            xx[i, j] = xx[j, i] = value
    return xx, xy, row["n"]


def fit(df: DataFrame, columns: list[str] | None = None, iterations: int = 1) -> DataFrame:
    """coefficient_idx, value: the last column regressed on the others, without intercept.

    The solution is exact, so ``iterations`` is accepted and computed once.
    """
    names = columns or df.columns
    if len(names) < 2:
        raise ValueError("a regression needs a feature and a target")
    xx, xy, n = gram(df, names[:-1], names[-1])
    if not n:
        raise ValueError("no rows")
    scale = np.sqrt(np.diag(xx))
    if (scale == 0).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e12:
        raise SingularError("the features are linearly dependent")
    solved = np.linalg.solve(xx, xy)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(solved)], "coefficient_idx long, value double")
