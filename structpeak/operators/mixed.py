"""Linear mixed-effects models of errors: fixed effects, and random intercepts of entities and of repetitions.

Errors of one entity, and errors of one repetition, are not independent of each other. The model is
``y = x b + u[entity] + v[repetition] + e`` with normal u, v and e, fitted by restricted maximum likelihood.

Entities may be many, so they never become columns. For a given ratio of the entity variance to the
residual variance, the covariance of an entity's n rows inverts to ``I - ratio / (1 + n ratio) 1 1'``; all the likelihood needs is
sums of products and products of entity sums, added up over the entities of equal n. Rows are grouped once by entity
(with partial sums, so one large entity is no burden) and once by n; a ratio costs one pass over the few
rows by n. Repetitions are few: they are columns with a penalty. Only matrices of the size of the design reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.operators.statistics import Z_95_TWO_SIDED
from structpeak.session import durable

#: Ratios of a variance to the residual variance that a search begins with.
RATIOS = (0.0, *(10 ** (k / 2) for k in range(-6, 7)))
ROUNDS = 4  # each makes the ratio six times finer


@dataclass
class MixedFit:
    """Fixed effects by term (NaN where a column is zero everywhere), variances, and the restricted deviance up to a constant."""

    terms: list[str]
    estimates: np.ndarray
    errors: np.ndarray
    residual: float
    entity: float
    repetition: float
    deviance: float
    rows: int
    ratio: float


def _upper(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def cluster_moments(rows: DataFrame, columns: Sequence[str], entity: str) -> DataFrame:
    """``size, entities, q_k, s_k``: for every number of rows an entity has, sums of products of columns and of products of entity sums.

    k counts the pairs of columns, upper triangle by rows. Rows with a null or a NaN in a column are left out; rows
    without an entity share one.
    """
    kept = rows.select(F.col(entity).alias("of"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        kept = kept.where(F.col(f"c{i}").isNotNull() & ~F.isnan(f"c{i}"))
    pairs = _upper(len(columns))
    per_entity = kept.groupBy("of").agg(
        F.count(F.lit(1)).alias("size"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(columns))],
        *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"q_{k}") for k, (i, j) in enumerate(pairs)],
    )
    return per_entity.groupBy("size").agg(
        F.count(F.lit(1)).alias("entities"), *[F.sum(f"q_{k}").alias(f"q_{k}") for k in range(len(pairs))],
        *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s_{k}") for k, (i, j) in enumerate(pairs)],
    )


def weighted_moments(moments: DataFrame, ratios: Sequence[float], m: int) -> list[tuple[float, int, float, np.ndarray]]:
    """For every ratio: itself, the number of rows, the log determinant of the entities' covariance, and the weighted products."""
    at = moments.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    weight = F.col("ratio") / (1 + F.col("size") * F.col("ratio"))
    pairs = _upper(m)
    sums = at.groupBy("ratio").agg(
        F.sum(F.col("entities") * F.col("size")).alias("n"), F.sum(F.col("entities") * F.log1p(F.col("size") * F.col("ratio"))).alias("d"),
        *[F.sum(F.col(f"q_{k}") - weight * F.col(f"s_{k}")).alias(f"m_{k}") for k in range(len(pairs))],
    )
    out = []
    for row in sorted(sums.collect()):  # a row a ratio
        product = np.zeros((m, m))
        for k, (i, j) in enumerate(pairs):
            product[i, j] = product[j, i] = row[f"m_{k}"]
        out.append((row["ratio"], row["n"], row["d"], product))
    return out


def _solved(product: np.ndarray, n: int, log_det: float, terms: Sequence[str], penalty: float) -> MixedFit:
    """Estimates at given ratios, from the products of [design, repetitions, y]."""
    p, r = len(terms), len(product) - len(terms) - 1
    live = np.flatnonzero(np.diag(product)[:p] > 0)
    left = np.concatenate((live, [p + r]))
    core = product[np.ix_(left, left)]
    if r and penalty > 0:
        z, across = product[p:p + r, p:p + r], product[p:p + r][:, left]
        core = core - across.T @ np.linalg.solve(z + np.eye(r) / penalty, across)
        log_det = log_det + np.linalg.slogdet(np.eye(r) + penalty * z)[1]
    xx, xy, yy = core[:-1, :-1], core[:-1, -1], core[-1, -1]
    free = n - len(live)
    scale = np.sqrt(np.diag(xx))
    if free < 1 or not len(live) or np.linalg.cond(xx / np.outer(scale, scale)) > 1e12:
        raise ValueError("too few rows, or design columns that determine each other")
    inverse = np.linalg.inv(xx)
    found = inverse @ xy
    residual = float(max(yy - xy @ found, 1e-14 * product[-1, -1]) / free)
    estimates, errors = np.full((2, p), np.nan)
    estimates[live], errors[live] = found, np.sqrt(residual * np.diag(inverse))
    deviance = float(free * math.log(residual) + log_det + np.linalg.slogdet(xx)[1]) if residual > 0 else -math.inf
    return MixedFit(list(terms), estimates, errors, residual, 0.0, penalty * residual, deviance, n, 0.0)


def _around(ratios: Sequence[float], i: int) -> list[float]:
    """Finer ratios between the neighbours of the i-th; beyond an end three powers of ten are added."""
    low = ratios[i - 1] if i else 0.0
    high = ratios[i + 1] if i + 1 < len(ratios) else max(ratios[i], ratios[-1]) * 1e3
    begin = low or high / 1e3
    return [*([0.0] if low == 0 else []), *np.geomspace(begin, high, 13).tolist()]


def _search(evaluate: Callable[[Sequence[float]], list[MixedFit]]) -> MixedFit:
    """The fit of least deviance over one ratio, by grids that close in on it."""
    ratios, best = list(RATIOS), None
    for _ in range(ROUNDS):
        found = evaluate(ratios)
        i = min(range(len(found)), key=lambda k: found[k].deviance)
        best = found[i] if best is None or found[i].deviance < best.deviance else best
        ratios = _around(ratios, i)
    return best


def mixed_profile(rows: DataFrame, y: str, design: Sequence[str], entity: str, ratios: Sequence[float]) -> list[MixedFit]:
    """The fit at every given ratio of the entity variance to the residual variance, without repetitions."""
    moments = cluster_moments(rows, [*design, y], entity)
    out = []
    for ratio, n, log_det, product in weighted_moments(moments, ratios, len(design) + 1):
        fit = _solved(product, n, log_det, design, 0.0)
        fit.ratio, fit.entity = ratio, ratio * fit.residual
        out.append(fit)
    return out


def mixed_model(rows: DataFrame, y: str, design: Sequence[str], entity: str, repetition: str | None = None, repetitions: Sequence = ()) -> MixedFit:
    """Restricted maximum likelihood fit of ``y`` on the ``design`` columns (a constant is a column of ones).

    ``repetitions`` lists the values of ``repetition`` that have an effect of their own; other values have none.
    Raises ValueError where rows are too few or design columns determine each other.
    """
    marks = [f"repetition {v}" for v in repetitions]
    chosen = rows.select(F.col(entity).alias("entity of"), *design, y, *[F.col(repetition).eqNullSafe(F.lit(v)).cast("double").alias(n) for v, n in zip(repetitions, marks, strict=True)])
    moments = durable(cluster_moments(chosen, [*design, *marks, y], "entity of"))

    def evaluate(ratios: Sequence[float]) -> list[MixedFit]:
        out = []
        for ratio, n, log_det, product in weighted_moments(moments, ratios, len(design) + len(marks) + 1):
            fit = _search(lambda tried: [_solved(product, n, log_det, design, t) for t in tried]) if marks else _solved(product, n, log_det, design, 0.0)
            fit.ratio, fit.entity = ratio, ratio * fit.residual
            out.append(fit)
        if not out:
            raise ValueError("too few rows, or design columns that determine each other")
        return out

    return _search(evaluate)


def effect_rows(fit: MixedFit) -> list[tuple[str, float | None, float | None, float | None, float | None]]:
    """``term, estimate, std_error, lower, upper`` (95 %) of every fixed effect, then the standard deviations of the random parts."""
    out = []
    for term, b, e in zip(fit.terms, fit.estimates.tolist(), fit.errors.tolist(), strict=True):
        known = not math.isnan(b)
        out.append((term, b, e, b - Z_95_TWO_SIDED * e, b + Z_95_TWO_SIDED * e) if known else (term, None, None, None, None))
    for name in ("entity", "repetition", "residual"):
        out.append((f"sd {name}", math.sqrt(getattr(fit, name)), None, None, None))
    return out
