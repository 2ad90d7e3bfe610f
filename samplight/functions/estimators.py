"""Estimates and confidence intervals from sums over a sample.

A sample of m units out of M stands for M / m units each; a unit is a row, or a
block that is taken whole. Sums and counts over a part of the sample take units
outside the part as zeros, so that the margin covers both the values and how
many of them fall in the part.
"""

from __future__ import annotations

#: Z by confidence level.
Z = ((0.99, 2.576), (0.95, 1.96))
#: Nominal confidence by sample size, and below all of them.
CONFIDENCE_LADDER = ((1000, 0.95), (500, 0.90), (100, 0.85), (50, 0.80))
LEAST_CONFIDENCE = 0.70
#: Sampling percent by wanted error in percent, and above all of them.
PERCENT_BY_ERROR = ((0.1, 25), (1, 20), (2, 15), (5, 10))
LEAST_PERCENT = 5


def z_score(confidence: float) -> float:
    """2.576 from 99 %, 1.96 from 95 %, else 1.645."""
    return next((z for level, z in Z if confidence >= level), 1.645)


def value_sql(agg: str) -> str:
    """The estimate, over __n and __s (count and sum in the part), __m (sampled rows) and __size (all rows)."""
    return {"sum": "__s * __size / __m", "count": "__n * __size / __m", "avg": "__s / __n"}[agg]


def margin_sql(agg: str, z: float, blocks: bool = False) -> str:
    """Half the interval; zero where it can't be told.

    Over __n, __s and __ss (sum of squares) of rows, __m and __size; for blocks
    also over __units of __all_units, and the sums of squares __cc of counts, __ss
    of sums and __cs of count times sum by block.
    """
    m, size = ("__units", "__all_units") if blocks else ("__m", "__size")
    rest = f"(1 - {m} / {size})"
    if agg == "avg" and blocks:
        apart = "(__ss - 2 * __s / __n * __cs + __s / __n * __s / __n * __cc)"
        body = f"{z} * sqrt({m} / ({m} - 1) * greatest(0, {apart}) * {rest}) / __n"
    elif agg == "avg":
        body = f"{z} * sqrt(greatest(0, __ss - __s * __s / __n) / (__n - 1) / __n)"
    else:
        x, xx = ("__s", "__ss") if agg == "sum" else ("__n", "__cc" if blocks else "__n")
        body = f"{z} * sqrt(greatest(0, {xx} - {x} * {x} / {m}) / ({m} - 1) / {m} * {rest}) * {size}"
    return f"case when __n < 2 or {m} < 2 or {m} >= {size} then 0D else {body} end"


def heuristic_confidence(sample_size: int) -> float:
    """The ladder of nominal confidence by sample size; a label, not a computed level."""
    return next((c for n, c in CONFIDENCE_LADDER if sample_size >= n), LEAST_CONFIDENCE)


def ladder_sql(n: str) -> str:
    """heuristic_confidence() over a column."""
    return "case " + " ".join(f"when {n} >= {k} then {c}D" for k, c in CONFIDENCE_LADDER) + f" else {LEAST_CONFIDENCE}D end"


def is_close(estimate: float, exact: float, threshold: float) -> bool:
    """Whether the relative error is within the threshold; an exact zero must be met exactly."""
    return estimate == 0 if exact == 0 else abs(estimate - exact) / abs(exact) <= threshold


def pilot_size(stddev: float, mean: float, error_percent: float, confidence: float = 0.95) -> int:
    """Rows that bring the relative margin of a mean below error_percent (the absolute one for a mean of zero)."""
    if error_percent <= 0:
        return 0
    return int((z_score(confidence) * stddev / ((abs(mean) or 1) * error_percent / 100)) ** 2) + 1


def percent_for_error(error_percent: float) -> int:
    """The fixed table from error to sampling percent."""
    return next((p for e, p in PERCENT_BY_ERROR if error_percent <= e), LEAST_PERCENT)
