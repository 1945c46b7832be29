"""Small models from sufficient statistics: a random-intercept model by REML, and a logistic model with its likelihood ratio."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..session import pinned
from .batches import summed
from .cluster import MAX_ROWS, bounded


def mixed_effect(df: DataFrame, patient: str, value: str, is_a: Column) -> dict:
    """value ~ is_a + (1 | patient) by REML: coef, se, ci_lo, ci_hi, p, icc, sigma2, tau2, n, n_patients.

    Rows are summed by patient on the executors; the ratio of the two variances is then searched on the driver.
    """
    rows = df.select(F.col(patient).alias("p"), F.col(value).cast("double").alias("y"), is_a.cast("int").alias("x")).where("p is not null and y is not null and x is not null and not isnan(y)")
    sums = bounded(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy")), 1_000_000)
    n, sx, sy, sxy, syy = (sums[c].to_numpy().astype(float) for c in ("n", "sx", "sy", "sxy", "syy"))
    total = n.sum()

    def solve(ratio: float):
        r = ratio / (1 + n * ratio)
        xx = np.array([[(n - r * n * n).sum(), (sx - r * n * sx).sum()], [(sx - r * n * sx).sum(), (sx - r * sx * sx).sum()]])
        xy = np.array([(sy - r * n * sy).sum(), (sxy - r * sx * sy).sum()])
        beta = np.linalg.solve(xx, xy)
        rss = (syy - r * sy * sy).sum() - beta @ xy
        sigma2 = rss / (total - 2)
        logl = -0.5 * ((total - 2) * math.log(max(sigma2, 1e-300)) + np.log1p(n * ratio).sum() + np.linalg.slogdet(xx)[1])
        return logl, beta, sigma2, xx

    best = max([-30.0, *np.linspace(-12, 8, 81)], key=lambda t: solve(math.exp(t))[0])
    low, high = best - 0.5, best + 0.5
    for _ in range(80):  # golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if solve(math.exp(a))[0] > solve(math.exp(b))[0] else (a, high)
    ratio = math.exp((low + high) / 2)
    _, beta, sigma2, xx = solve(ratio)
    se = math.sqrt(sigma2 * np.linalg.inv(xx)[1, 1])
    z = beta[1] / se
    coef = float(beta[1])
    return {"coef": coef, "se": se, "ci_lo": coef - 1.96 * se, "ci_hi": coef + 1.96 * se, "p": 2 * tails.norm_sf(abs(float(z))), "icc": ratio / (1 + ratio), "sigma2": float(sigma2), "tau2": float(sigma2 * ratio), "n": int(total), "n_patients": len(n)}


def shrinkage(naive: float, mixed: float) -> float | None:
    """Per cent by which an effect shrinks once patients are accounted for."""
    return None if naive == 0 else 100 * (1 - mixed / naive)


def _logit_parts(y: np.ndarray, x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Log-likelihood, its gradient and the information matrix of some rows, one after the other."""
    s = x @ beta
    p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
    return np.concatenate([[(y * s - np.logaddexp(0, s)).sum()], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def logit(df: DataFrame, label: str, columns: list[str], steps: int = 100, small: int = MAX_ROWS) -> dict:
    """label ~ 1 + columns by Newton's method: coefficients, log-likelihoods, and p of the likelihood ratio. Rows with a null are left
    out. Up to `small` rows the driver holds them; of more, each step is a pass that adds up likelihood, gradient and information."""
    rows = pinned(df.select(F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna(), "rows")
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        raise ValueError("no rows")
    d = len(columns) + 1
    design = lambda y, *x: (np.asarray(y, float), np.stack([np.ones(len(y)), *(np.asarray(c, float) for c in x)], axis=1))
    if n <= small:
        t = rows.toArrow()
        held = design(*(c.to_numpy() for c in t.columns))
        parts = lambda beta: _logit_parts(*held, beta)
    else:
        parts = lambda beta: summed(rows, lambda *c: _logit_parts(*design(*(x.to_numpy() for x in c)), beta), 1 + d + d * d)
    beta = np.zeros(d)
    now = parts(beta)
    for _ in range(steps):
        change = np.linalg.lstsq(now[1 + d :].reshape(d, d) + 1e-12 * np.eye(d), now[1 : 1 + d], rcond=None)[0]
        after = parts(beta + change)
        while after[0] < now[0] - 1e-12 and np.abs(change).max() > 1e-12:
            change = change / 2
            after = parts(beta + change)
        beta, now = beta + change, after
        if np.abs(change).max() < 1e-10:
            break
    share = positive / n
    null = float(n * (share * math.log(share) + (1 - share) * math.log1p(-share))) if 0 < share < 1 else 0.0
    ratio = max(0.0, 2 * (float(now[0]) - null))
    return {"coef": dict(zip(["intercept", *columns], beta.tolist())), "log_likelihood": float(now[0]), "log_likelihood_null": null, "llr_p": tails.chi2_sf(ratio, len(columns)) if columns else 1.0, "n": n}
