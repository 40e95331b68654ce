"""Robust linear regression of many groups in one job.

The objective is the sum over a group's rows of ``s + s * H(r / s)`` plus a small weight of the squared coefficients, with ``H`` quadratic up to
``epsilon`` and linear beyond it; coefficients, intercept and the scale ``s`` are found together. While the set of rows beyond ``epsilon`` stays
the same, the minimum has a closed form in sums over the rows: the coefficients are linear in the scale, and the scale solves a quadratic equation.
So each step is one aggregation grouped by key, however many groups there are and however large one is, and the
steps end when no group's rows change sides any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stationgrid.operators.sizes import broadcast_if_small
from stationgrid.session import cut_lineage

ALPHA = 1e-4
STEPS = 60
#: From this step on only half of each move is made, which ends cycles between two sets of rows.
DAMPED = 20
TOLERANCE = 1e-10


def _moments(design: list[Column], y: Column, out: Column, above: Column) -> list[Column]:
    """Sums of products over the rows within ``epsilon`` and of signs over the others."""
    inside = lambda c: F.sum(F.when(out, F.lit(0.0)).otherwise(c))
    wide = [*design, y]
    products = [inside(a * b).alias(f"_p{i}_{j}") for i, a in enumerate(wide) for j, b in enumerate(wide) if j >= i]
    sign = F.when(above, F.lit(1.0)).otherwise(F.lit(-1.0))
    signs = [F.sum(F.when(out, sign * c).otherwise(F.lit(0.0))).alias(f"_s{i}") for i, c in enumerate(design)]
    return [*products, *signs, F.count(F.lit(1)).alias("_n"), F.sum(out.cast("double")).alias("_out")]


def _minimum(row: dict, p: int, epsilon: float, alpha: float) -> tuple[np.ndarray, float] | None:
    """Coefficients with the intercept last, and the scale, for the sides the rows were on."""
    a = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            a[i, j] = a[j, i] = row[f"_p{i}_{j}"]
    gram, xy, yy = a[:p, :p], a[:p, p], a[p, p]
    ridge = alpha * (row["scale"] or 0.0) * np.diag([1.0] * (p - 1) + [0.0])
    pinv = np.linalg.pinv(gram + ridge, hermitian=True)
    base, pull = pinv @ xy, pinv @ (epsilon * np.array([row[f"_s{i}"] for i in range(p)]))
    # residuals of the rows inside are u - s * v with u = y - x base and v = x pull
    uu = max(yy - 2 * base @ xy + base @ gram @ base, 0.0)
    uv = pull @ xy - base @ gram @ pull
    vv = pull @ gram @ pull
    quad, half = row["_n"] - epsilon**2 * row["_out"] - vv, uv
    root = half * half + quad * uu
    if quad > 0 and root >= 0:
        scale = (np.sqrt(root) - half) / quad
        return base + scale * pull, float(scale)
    return None


def huber_fits(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str], epsilon: float, alpha: float = ALPHA) -> DataFrame:
    """``(by..., n, coefficients, intercept, scale, settled)``: one robust fit per key.

    Rows with a NULL among label, features and keys do not take part. A group whose rows all lie on one plane has scale 0; one with fewer rows than
    unknowns gets the shortest solution. ``settled`` is false where rows still changed sides after STEPS steps. No keys
    make one group of all rows.
    """
    by, p = list(by), len(features) + 1
    keys = by or ["_all"]
    source = rows if by else rows.withColumn("_all", F.lit(0))
    data = source.select(*keys, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("_y")).na.drop().persist()
    design = [*(F.col(f"_x{i}") for i in range(p - 1)), F.lit(1.0)]
    state_type = ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys) + ", b array<double>, scale double, n bigint, settled boolean"

    def solve(step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    old, scale = np.asarray(row["b"] if row["b"] is not None else np.zeros(p), dtype=float), row["scale"]
                    scale = None if scale is None or np.isnan(scale) else scale
                    found = _minimum(row | {"scale": scale}, p, epsilon, alpha)
                    if found is None:  # too many rows lie outside: a wider scale brings some back
                        new, wide = old, 2.0 * (scale or 1.0)
                    else:
                        new, wide = found
                        if step >= DAMPED and scale is not None:
                            new, wide = (new + old) / 2, (wide + scale) / 2
                    near = found is not None and scale is not None and abs(wide - scale) <= TOLERANCE * (1 + wide) and bool(
                        np.all(np.abs(new - old) <= TOLERANCE * (1 + np.abs(new)))
                    )
                    out.append({**{k: row[k] for k in keys}, "b": new.tolist(), "scale": wide, "n": row["_n"], "settled": near})
                if out:
                    yield pd.DataFrame(out)
        return run

    # the first step has no scale, so all rows are inside: least squares
    state = data.select(*keys).distinct().selectExpr(*keys, "CAST(NULL AS ARRAY<DOUBLE>) AS b", "CAST(NULL AS DOUBLE) AS scale", "0L AS n", "false AS settled")
    state = cut_lineage(state)
    for step in range(STEPS):
        known = state.filter("NOT settled").select(*keys, "b", "scale")
        joined = data.join(broadcast_if_small(known), keys)
        fit = F.coalesce(sum((F.col("b")[i] * c for i, c in enumerate(design)), F.lit(0.0)), F.lit(0.0))
        residual = F.col("_y") - fit
        outside = F.coalesce(F.abs(residual) > epsilon * F.col("scale"), F.lit(False))
        sums = joined.groupBy(*keys).agg(*_moments(design, F.col("_y"), outside, residual > 0), F.first("b").alias("b"), F.first("scale").alias("scale"))
        moved = sums.mapInPandas(solve(step), state_type)
        state = cut_lineage(state.filter("settled").unionByName(moved))
        if state.filter("NOT settled").isEmpty():
            break
    data.unpersist()
    return state.select(*by, "n", F.slice("b", 1, p - 1).alias("coefficients"), F.col("b")[p - 1].alias("intercept"), "scale", "settled")
