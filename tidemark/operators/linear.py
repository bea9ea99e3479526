"""Linear models from sums: one combining aggregation for ridge and lasso, one a step for logistic.

``moments`` gathers, per group (a horizon, say), the count, the sums and all products of features and
target in one pass over the rows; partial sums are combined before the shuffle, so a group of any size
sends one row a task.  Ridge and lasso of every group and penalty follow from those few numbers on
the driver, without reading the rows again: features are scaled by their population deviation as in
``operators.split``, which the sums give as well.

``fit_logistic`` minimises the penalised, weighted log loss by Newton steps.  Loss, gradient and
Hessian are built-in sums over the rows, for all groups in one pass a step; a step that does not
lower the loss is halved.  It ends when no component of the gradient exceeds ``tolerance`` a row.

Products are summed about the values of one row, read beforehand, so that a feature with a small
deviation from a large mean keeps its digits.

Defined results: rows without a target are left out; a null or NaN feature counts as 0, as in schema
completion; a constant feature has coefficient 0; a group without rows has no model; equal rows count
as often as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of scaled features, and what scales them."""

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    intercept: float
    n: int

    def predicted(self) -> Column:
        """The linear predictor as a generated expression."""
        return linear_sum(self.features, self.means, self.scales, self.coefficients, self.intercept)


def scaled(feature: str, mean: Column, scale: Column) -> Column:
    return (number(feature) - mean) / scale


def number(feature: str) -> Column:
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(0.0)), F.lit(0.0))


def linear_sum(features, means, scales, coefficients, intercept) -> Column:
    out = F.lit(float(intercept))
    for c, m, s, b in zip(features, means, scales, coefficients):
        if b:
            out = out + scaled(c, F.lit(float(m)), F.lit(float(s))) * F.lit(float(b))
    return out


@dataclass(frozen=True)
class Moments:
    """Count, means, and centred products of the features and the target (last) of a group."""

    n: int
    means: np.ndarray
    products: np.ndarray

    @property
    def variances(self) -> np.ndarray:
        return np.maximum(np.diag(self.products)[:-1], 0) / self.n

    @property
    def varying(self) -> np.ndarray:
        """Features that are not constant, as far as the digits tell."""
        return self.variances > 1e-24 * self.means[:-1] ** 2

    @property
    def scales(self) -> np.ndarray:
        """Population deviations of the features, 1 for a constant one."""
        return np.where(self.varying, np.sqrt(self.variances), 1.0)


def with_target(rows: DataFrame, target: str) -> DataFrame:
    return rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))


def moments(rows: DataFrame, features: list[str], target: str, group: str) -> dict[object, Moments]:
    """Moments of every group, from one aggregation."""
    k = len(features) + 1
    known = with_target(rows, target).select(
        F.col(group).alias("group"),
        *[number(c).alias(f"v{i}") for i, c in enumerate([*features, target])])
    one = known.limit(1).collect()
    if not one:
        return {}
    origin = np.array([one[0][f"v{i}"] for i in range(k)])
    known = known.select("group", *[(F.col(f"v{i}") - F.lit(float(o))).alias(f"v{i}")
                                    for i, o in enumerate(origin)])
    sums = ["count(*) AS n", *[f"sum(v{i}) AS s{i}" for i in range(k)]]
    sums += [f"sum(v{i} * v{j}) AS p{i}_{j}" for i in range(k) for j in range(i, k)]
    found = {}
    for r in known.groupBy("group").agg(*map(F.expr, sums)).collect():       # one row a group
        mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        raw = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        found[r["group"]] = Moments(r["n"], origin + mean, raw - r["n"] * np.outer(mean, mean))
    return found


def _standardised(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Products of the scaled features, and theirs with the centred target."""
    scale = m.scales
    inner = m.products[:-1, :-1] / np.outer(scale, scale)
    return inner, m.products[:-1, -1] / scale


def ridge(m: Moments, features: list[str], alpha: float = 1.0) -> LinearModel:
    """Least squares with ``alpha`` times the squared coefficients, by Cholesky's factors."""
    inner, cross = _standardised(m)
    free = np.flatnonzero(m.varying)
    lower = np.linalg.cholesky(inner[np.ix_(free, free)] + alpha * np.eye(len(free)))
    b = np.zeros(len(cross))
    b[free] = np.linalg.solve(lower.T, np.linalg.solve(lower, cross[free]))
    return LinearModel(tuple(features), m.means[:-1], m.scales, b, float(m.means[-1]), m.n)


def lasso(m: Moments, features: list[str], alpha: float = 0.001, rounds: int = 100_000,
          tolerance: float = 1e-12) -> LinearModel:
    """Half the mean squared error with ``alpha`` times the absolute coefficients, by coordinate
    descent on the products."""
    inner, cross = (x / m.n for x in _standardised(m))
    b = np.zeros(len(cross))
    free = np.flatnonzero(m.varying)
    before = b.copy()
    for sweep in range(rounds):
        if sweep % 10 == 9:            # along a flat valley sweeps crawl; go to its end at once
            b, before = _along(inner, cross, alpha, b, b - before), b.copy()
        most = 0.0
        for j in free:
            rest = cross[j] - inner[j] @ b + inner[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / inner[j, j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < tolerance:
            break
    return LinearModel(tuple(features), m.means[:-1], m.scales, b, float(m.means[-1]), m.n)


def _along(inner: np.ndarray, cross: np.ndarray, alpha: float, b: np.ndarray, d: np.ndarray
           ) -> np.ndarray:
    """The least point of the lasso's objective from ``b`` on in direction ``d``."""
    curve = d @ inner @ d
    with np.errstate(divide="ignore", invalid="ignore"):
        turns = -b / d                 # where a coefficient passes zero
    turns = np.where(np.isfinite(turns) & (turns > 0), turns, np.inf)
    at = 0.0
    for stop in [*np.sort(turns[turns < np.inf]), np.inf]:
        middle = b + (at + (min(stop, at + 2.0) - at) / 2) * d
        slope = d @ (inner @ (b + at * d) - cross) + alpha * (np.sign(middle) @ d)
        if slope >= 0:
            break
        if curve > 0 and at - slope / curve <= stop:
            at -= slope / curve
            break
        if stop == np.inf:
            break
        at = stop
    return np.where(turns == at, 0.0, b + at * d)


def fit_logistic(rows: DataFrame, features: list[str], label: str, group: str, c: float = 1.0,
                 tolerance: float = 1e-10, steps: int = 100) -> dict[object, LinearModel]:
    """Logistic models of every group, with balanced class weights and the penalty 1 / (2 c).

    ``rows`` is read once a step and should be stored.
    """
    found = moments(rows, features, label, group)
    models = {}
    for g, m in found.items():
        up = m.means[-1]                                   # share of label 1
        weights = [0.5 / x if x else 0.0 for x in (1 - up, up)]
        if 0.0 in weights:                                 # one class: it weighs 1
            weights = [float(x > 0) for x in weights]
        models[g] = {"m": m, "weights": weights, "b": np.zeros(len(features) + 1), "step": None,
                     "loss": np.inf, "done": False}

    p = len(features)
    # What changes from step to step comes as a table of one row a group, so that all steps share
    # their generated code.
    names = [*(f"{x}{i}" for x in ("m", "s") for i in range(p)), "w0", "w1",
             *(f"b{i}" for i in range(p + 1))]
    schema = T.StructType([T.StructField("group", rows.schema[group].dataType),
                           *[T.StructField(n, T.DoubleType()) for n in names]])
    known = with_target(rows, label).select(
        F.col(group).alias("group"), F.col(label).cast("double").alias("y"),
        *[number(c).alias(f"v{i}") for i, c in enumerate(features)])
    x = [f"(v{i} - m{i}) / s{i} AS x{i}" for i in range(p)]
    z = " + ".join([f"b{p}", *(f"x{i} * b{i}" for i in range(p))])
    loss = "sum(w * (greatest(z, 0) + log1p(exp(-abs(z))) - y * z)) AS loss"
    first = [f"sum(w * (q - y) * x{i}) AS g{i}" for i in range(p + 1)]
    second = [f"sum(curve * x{i} * x{j}) AS h{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]
    for _ in range(steps):
        now = [(g, *map(float, (*s["m"].means[:-1], *s["m"].scales, *s["weights"], *s["b"])))
               for g, s in models.items() if not s["done"]]
        if not now:
            break
        given = F.broadcast(rows.sparkSession.createDataFrame(now, schema))    # one row a group
        told = known.join(given, "group").selectExpr(
            "group", "y", "if(y = 1, w1, w0) AS w", "1D AS x" + str(p), f"b{p}", *x,
            *[f"b{i}" for i in range(p)])
        told = told.selectExpr("*", f"{z} AS z").selectExpr("*", "1 / (1 + exp(-z)) AS q")
        told = told.selectExpr("*", "w * q * (1 - q) AS curve").groupBy("group").agg(
            *map(F.expr, (loss, *first, *second)))
        for r in told.collect():
            _advance(models[r["group"]], r, p, c, tolerance)
    return {g: LinearModel(tuple(features), s["m"].means[:-1], s["m"].scales, s["b"][:-1],
                           float(s["b"][-1]), s["m"].n) for g, s in models.items()}


def _advance(state: dict, sums, p: int, c: float, tolerance: float) -> None:
    """One Newton step, or half of the last one if that did not lower the loss."""
    penalty = np.append(np.full(p, 1.0 / c), 0.0)
    loss = sums["loss"] + 0.5 * float(penalty @ state["b"] ** 2)
    if loss > state["loss"] * (1 + 1e-13):
        state["step"] = state["step"] / 2
        state["b"] = state["before"] + state["step"]
        return
    gradient = np.array([sums[f"g{i}"] for i in range(p + 1)]) + penalty * state["b"]
    state["loss"], state["gradient"] = loss, gradient
    if np.max(np.abs(gradient)) <= tolerance * state["m"].n:
        state["done"] = True
        return
    hessian = np.diag(penalty)
    for i in range(p + 1):
        for j in range(i, p + 1):
            hessian[i, j] += sums[f"h{i}_{j}"]
            hessian[j, i] = hessian[i, j]
    state["before"] = state["b"]
    state["step"] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    state["b"] = state["b"] + state["step"]


def optimality(rows: DataFrame, model: LinearModel, target: str, kind: str, penalty: float
               ) -> DataFrame:
    """(feature, residual, n): how far each coefficient is from the optimum of its objective over
    ``rows``, per row; the intercept comes as a feature of that name.

    ``kind`` is ridge or logistic (the penalty times the coefficient is its pull; logistic rows weigh
    as if both classes were equally frequent) or lasso.
    """
    y, z = F.col(target).cast("double"), model.predicted()
    miss = y - z
    known = with_target(rows, target)
    weight = F.lit(1.0)
    if kind == "logistic":
        share = known.agg(F.avg(y)).first()[0]
        weight = F.when(y == 1, 0.5 / share).otherwise(0.5 / (1 - share)) if 0 < share < 1 else weight
        miss = y - 1 / (1 + F.exp(-z))
    told = known.select(weight.alias("w"), miss.alias("miss"), *[
        scaled(c, F.lit(float(m)), F.lit(float(s))).alias(f"x{i}")
        for i, (c, m, s) in enumerate(zip(model.features, model.means, model.scales))])
    pulls = told.agg(F.count("*").alias("n"), F.avg(F.col("w") * F.col("miss")).alias("p"), *[
        F.avg(F.col("w") * F.col("miss") * F.col(f"x{i}")).alias(f"p{i}")
        for i in range(len(model.features))])
    parts = [F.struct(F.lit("intercept").alias("feature"), F.col("p").alias("residual"))]
    for i, (c, b) in enumerate(zip(model.features, map(float, model.coefficients))):
        pull = F.col(f"p{i}")
        if kind != "lasso":
            residual = pull - F.lit(penalty * b) / F.col("n")
        elif b:
            residual = pull - F.lit(penalty * float(np.sign(b)))
        else:
            residual = F.greatest(F.abs(pull) - penalty, F.lit(0.0))
        parts.append(F.struct(F.lit(c).alias("feature"), residual.alias("residual")))
    return pulls.select("n", F.explode(F.array(*parts)).alias("part")).select(
        "part.feature", "part.residual", "n")
