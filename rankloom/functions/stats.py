"""Numeric column functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the public rational approximation of the inverse normal distribution (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in (*coefficients[1:], *(() if last is None else (last,))):
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1; null outside and for null."""
    q = p - 0.5
    r = q * q
    middle = _poly(_A, r) * q / _poly(_B, r, 1.0)
    t = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _poly(_C, t) / _poly(_D, t, 1.0)
    inside = F.when((p >= _LOW) & (p <= 1 - _LOW), middle).when(p < _LOW, tail).otherwise(-tail)
    return F.when((p > 0) & (p < 1), inside)


def probit_sql(p: str) -> str:
    """The same as SQL text, for 0 < p < 1."""

    def poly(cs: tuple[float, ...], x: str) -> str:
        out = f"({cs[0]!r})"
        for c in cs[1:]:
            out = f"({out}*{x}+({c!r}))"
        return out

    r, t = f"(({p}-0.5)*({p}-0.5))", f"sqrt(-2.0*ln(least({p},1.0-{p})))"
    middle = f"{poly(_A, r)}*({p}-0.5)/{poly((*_B, 1.0), r)}"
    tail = f"{poly(_C, t)}/{poly((*_D, 1.0), t)}"
    return f"(case when {p}>={_LOW!r} and {p}<={1 - _LOW!r} then {middle} when {p}<{_LOW!r} then {tail} else -({tail}) end)"
