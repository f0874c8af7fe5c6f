"""Least squares from aggregated cross products, with heteroskedasticity-robust (HC3) errors in a second pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _design(columns: list[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]


def normal_equations(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """One row: n, the sums of all products of the design's columns (xx) and with y (xy), and of y and y * y."""
    x, t = _design(columns), F.col(y).cast("double")
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * t).alias(f"xy_{i}") for i in range(k)]
    return df.dropna("any", subset=[y, *columns]).agg(F.count("*").alias("n"), F.sum(t).alias("sy"), F.sum(t * t).alias("syy"), *sums)


def ols(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """term, coefficient, se, t, r2, aic, n: a row per term; se are HC3 errors with each row's true leverage.

    Rows with a null are left out. Both passes are aggregates of (terms)^2 numbers,
    so the driver holds nothing that grows with the rows. Dependent columns are refused.
    """
    k = len(columns) + 1
    row = normal_equations(df, y, columns).first()
    if row["n"] <= k:
        raise ValueError("too few rows")
    xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    scale = np.sqrt(np.diag(xx))
    if (scale == 0).any() or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < k:
        raise ValueError("the columns depend on one another")
    inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ np.array([row[f"xy_{i}"] for i in range(k)])
    x, t = _design(columns), F.col(y).cast("double")
    total = lambda terms: sum(terms[1:], terms[0])
    residual = t - total([x[i] * float(beta[i]) for i in range(k)])
    leverage = total([x[i] * x[j] * float(inverse[i, j]) for i in range(k) for j in range(k)])
    weight = F.pow(residual / (1 - leverage), 2)
    second = df.dropna("any", subset=[y, *columns]).agg(F.sum(residual * residual).alias("ssr"), *[F.sum(x[i] * x[j] * weight).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[second[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    n, ssr = row["n"], second["ssr"]
    r2 = 1 - ssr / (row["syy"] - row["sy"] ** 2 / n)
    aic = n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * k
    rows = [(name, float(b), float(s), float(b / s), float(r2), float(aic), int(n)) for name, b, s in zip(["const", *columns], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, r2 double, aic double, n long")


def spatial_lag(df: DataFrame, weights: DataFrame, key: str, value: str, out: str = "lag") -> DataFrame:
    """key, out: the weighted mean of the neighbours' values; weights has key, neighbour, weight."""
    values = df.select(F.col(key).alias("neighbour"), F.col(value).alias("__v"))
    return weights.join(values, "neighbour").groupBy(key).agg(F.sum(F.col("weight") * F.col("__v")).alias(out))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the hash of a key: the same ones every time."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def spatial_fit(df: DataFrame, weights: DataFrame, key: str, y: str, columns: list[str], kind: str = "lag", bound: int = 3000) -> DataFrame:
    """term, coefficient: a spatial lag or spatial error model by maximum likelihood; the term rho is the spatial one.

    weights has key, neighbour, weight with rows that sum to 1. The likelihood
    needs the determinant of a rows x rows matrix, so more than `bound` rows are
    refused; take a sample() first. Rows with a null are left out with their weights.
    """
    if kind not in ("lag", "error"):
        raise ValueError(kind)
    rows = df.dropna("any", subset=[key, y, *columns]).select(key, y, *columns).orderBy(key).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"spatial models are for {bound} rows at most")
    place = {r[0]: i for i, r in enumerate(rows)}
    n = len(rows)
    w = np.zeros((n, n))
    kept = weights.join(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in place], f"{key} {df.schema[key].dataType.simpleString()}")), key)
    for r in kept.select(key, "neighbour", "weight").toLocalIterator():
        if r["neighbour"] in place:
            w[place[r[key]], place[r["neighbour"]]] += r["weight"]
    t = np.array([float(r[1]) for r in rows])
    x = np.column_stack([np.ones(n), *[[float(r[2 + j]) for r in rows] for j in range(len(columns))]])
    values = np.linalg.eigvals(w)
    k = x.shape[1]
    both = np.column_stack([t, w @ t, x, w @ x])
    cross = both.T @ both  # all that the likelihood needs of the rows

    def at(rho: float) -> tuple[float, np.ndarray]:
        turn = np.zeros((2 + 2 * k, 1 + k))  # the columns y - rho W y, and X or X - rho W X
        turn[0, 0], turn[1, 0] = 1, -rho
        turn[2 : 2 + k, 1:] = np.eye(k)
        turn[2 + k :, 1:] = -rho * np.eye(k) * (kind == "error")
        c = turn.T @ cross @ turn
        beta = np.linalg.solve(c[1:, 1:], c[1:, 0])
        return float(np.log(np.abs(1 - rho * values)).sum() - n / 2 * np.log((c[0, 0] - beta @ c[1:, 0]) / n)), beta

    low, high, step = -0.99, 0.99, (5**0.5 - 1) / 2
    while high - low > 1e-7:  # golden section over the concentrated likelihood
        p, q = high - step * (high - low), low + step * (high - low)
        low, high = (low, q) if at(p)[0] > at(q)[0] else (p, high)
    rho = (low + high) / 2
    out = [("rho", rho), *zip(["const", *columns], map(float, at(rho)[1]))]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double")
