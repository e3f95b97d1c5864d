"""Regression, metrics and tests (MR01-MR08, SO04, AG37, AG40)."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.quantiles import quantiles


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """MR01: coefficients and intercept of ridge regression, from one aggregation (intercept not penalised)."""
    rows = df.dropna(subset=[*features, target])
    names = [*features, target]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    p = len(features)
    cov = lambda i, j: sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0
    xx = np.array([[cov(i, j) for j in range(p)] for i in range(p)]) * sums.n
    xy = np.array([cov(i, p) for i in range(p)]) * sums.n
    w = np.linalg.solve(xx + alpha * np.eye(p), xy) if sums.n else np.zeros(p)
    return w, (sums[f"m{p}"] or 0.0) - sum(w[i] * (sums[f"m{i}"] or 0.0) for i in range(p))


def predicted(features: list[str], model: tuple[np.ndarray, float]) -> Column:
    """MR01: predictions, never below 0."""
    return F.greatest(sum((F.col(c) * float(w) for c, w in zip(features, model[0], strict=True)), F.lit(float(model[1]))), F.lit(0.0))


def importance(features: list[str], model: tuple[np.ndarray, float]) -> list[tuple[str, float]]:
    """MR01, SO04: share of absolute coefficients, largest first."""
    total = float(np.abs(model[0]).sum()) or 1.0
    return sorted(((c, abs(float(w)) / total) for c, w in zip(features, model[0], strict=True)), key=lambda x: (-x[1], x[0]))


def metrics(df: DataFrame, actual: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """MR03: r2, rmse, mae, mape (actual not 0), mean and population deviation of residuals."""
    y, p = F.col(actual), F.col(prediction)
    e = y - p
    return df.groupBy(*(by or [])).agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
    )


def log_likelihood(rss: float, n: int) -> float:
    """MR04: of a normal model."""
    return -n / 2 * (math.log(2 * math.pi * rss / n) + 1)


def chi2_sf(x: float, df: int) -> float:
    """MR04: survival of the chi-squared distribution, by the series or the continued fraction of the incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def likelihood_ratio(small: tuple[float, int], large: tuple[float, int]) -> tuple[float, float]:
    """MR04: statistic and p-value of nested models (log-likelihood, parameters)."""
    stat = 2 * (large[0] - small[0])
    return stat, chi2_sf(stat, large[1] - small[1])


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def information_criteria(log_like: float, parameters: int, n: int) -> tuple[float, float]:
    """MR05: AIC and BIC."""
    return 2 * parameters - 2 * log_like, parameters * math.log(n) - 2 * log_like


def permutation_importance(df: DataFrame, features: list[str], target: str, model: tuple[np.ndarray, float], id_column: str = "id", repeats: int = 3) -> DataFrame:
    """MR06: rise of the mean squared error when a feature's values are dealt anew.

    A value goes to the row whose hash comes at its place in another hash order, within buckets of equal rank counts, so
    nothing is ranked in one task: rows are matched by bucket and position there.
    """
    from pyspark.sql import Window

    out = None
    base = F.avg((F.col(target) - predicted(features, model)) ** 2)
    buckets = F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(64))
    placed = df.withColumn("__b", buckets).withColumn("__p", F.row_number().over(Window.partitionBy("__b").orderBy(id_column)))
    for feature in features:
        for r in range(repeats):
            dealt = df.select(F.col(feature).alias("__v"), buckets.alias("__b"), F.xxhash64(id_column, F.lit(100 + r)).alias("__h")).withColumn("__p", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).drop("__h")
            moved = placed.join(dealt, ["__b", "__p"]).withColumn("__old", F.col(feature)).withColumn(feature, F.col("__v"))
            one = moved.agg(base.alias("mse")).select(F.lit(feature).alias("feature"), F.lit(r).alias("repeat"), "mse")
            out = one if out is None else out.unionByName(one)
    plain = df.agg(base.alias("base"))
    return out.crossJoin(plain).groupBy("feature").agg(F.avg(F.col("mse") - F.col("base")).alias("importance"))


def partial_dependence(df: DataFrame, feature: str, features: list[str], model: tuple[np.ndarray, float], points: int = 10) -> DataFrame:
    """MR07: mean prediction with the feature held at points between its 5th and 95th percentiles."""
    low, high = quantiles(df, feature, [0.05, 0.95])
    at = F.array(*(F.lit(low + (high - low) * k / (points - 1)) for k in range(points)))
    return df.withColumn(feature, F.explode(at)).groupBy(feature).agg(F.avg(predicted(features, model)).alias("prediction"))


def residual_diagnostics(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """MR05: residuals' mean and deviation, and a Breusch-Pagan statistic: r2 of squared residuals on predictions times n, with its p-value; Shapiro's test is left out."""
    r = F.col(y) - F.col(prediction)
    rows = df.select(r.alias("r"), (r * r).alias("rr"), F.col(prediction).alias("q"))
    out = rows.agg(F.avg("r").alias("residual_mean"), F.stddev_pop("r").alias("residual_std"), (F.corr("rr", "q") ** 2 * F.count("r")).alias("bp_statistic"))
    return out


def nested_workflow(df: DataFrame, sets: list[list[str]], target: str, alpha: float = 0.0, level: float = 0.05) -> list[dict]:
    """MR08: ridge models of growing feature sets: fit, criteria, the likelihood-ratio test against the set before, and whether its hypothesis (the new features help) is supported."""
    out: list[dict] = []
    before = None
    for names in sets:
        w, b = ridge(df, names, target, alpha)
        line = sum((F.col(c) * float(x) for c, x in zip(names, w, strict=True)), F.lit(float(b)))
        s = df.agg(F.sum((F.col(target) - line) ** 2).alias("rss"), F.count(target).alias("n"), (F.var_pop(target) * F.count(target)).alias("tss")).first()
        now = (log_likelihood(s.rss, s.n), len(names) + 2)
        aic, bic = information_criteria(*now, s.n)
        statistic, p = likelihood_ratio(before, now) if before else (None, None)
        out.append({"model": "+".join(names), "r2": 1 - s.rss / s.tss, "aic": aic, "bic": bic, "statistic": statistic, "p": p, "supported": None if p is None else p < level})
        before = now
    return out


def best_models(results: DataFrame) -> DataFrame:
    """AG40: the best model by each metric, ties to the first name; and whether r2 varies by more than 0.1."""
    means = results.groupBy("model").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.stddev_pop("r2").alias("r2_std"))
    return means.agg(F.min(F.struct((-F.col("r2")).alias("v"), "model"))["model"].alias("best_r2"), F.min(F.struct("rmse", "model"))["model"].alias("best_rmse"), F.count_if(F.col("r2_std") > 0.1).alias("unstable"))
