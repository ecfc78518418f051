"""Column helpers: guarded arithmetic, clipping, full-window gating, bins, p-values.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage code generation (the p-value uses higher-order functions,
but only on per-problem rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Col, b: Col) -> Column:
    """a / b, null when b is 0 or null (Spark's ANSI division would raise)."""
    return F.try_divide(_c(a), _c(b))


def clip_keep_null(c: Col, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null (bare least/greatest would skip the null)."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def finite_or_zero(c: Col) -> Column:
    """NaN and +-Inf become 0.0, null stays null."""
    c = _c(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def full_window(agg, x: Col, frame, n: int) -> Column:
    """``agg(x)`` over ``frame`` only when the frame holds ``n`` non-null values.

    A rolling statistic of ``n`` rows is defined only on a full window: shorter
    frames at the start of a history and frames touching a null give null.
    """
    x = _c(x)
    return F.when(F.count(x).over(frame) == F.lit(n), agg(x).over(frame))


def round_half(c: Col, tie_mode: str = "up") -> Column:
    c = _c(c)
    if tie_mode == "even":
        return F.bround(c, 0)
    if tie_mode != "up":
        raise ValueError(f"tie_mode must be 'up' or 'even', got {tie_mode!r}")
    return F.round(c, 0)


def state_bin(scaled: Col, tie_mode: str = "up") -> Column:
    """Integer bin of an already scaled value (``rating / 100``, ``acc * 10``):
    rounded with ``tie_mode``; NaN/Inf count as 0, null stays null."""
    return round_half(finite_or_zero(scaled), tie_mode).cast("int")


# fixed values: 1/sqrt(pi), sqrt(2); series below 2.5, continued fraction above
_INV_SQRT_PI = 1.0 / math.sqrt(math.pi)
_SQRT2 = math.sqrt(2.0)
_SERIES_TERMS = 100
_CF_TERMS = 60
_SWITCH = 2.5


def erfc(x: Col) -> Column:
    """Complementary error function for x >= 0, double precision (abs err ~1e-15).

    x < 2.5: erf(x) = exp(-x^2) * sum_n x^(2n+1) / Gamma(n + 3/2), terms built
    by the ratio x^2 / (n + 1/2). x >= 2.5: Laplace continued fraction
    erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...)))),
    evaluated from the tail.
    """
    x = _c(x).cast("double")
    x2 = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS - 1)),
        F.struct((F.lit(2.0 * _INV_SQRT_PI) * x).alias("t"), (F.lit(2.0 * _INV_SQRT_PI) * x).alias("s")),
        lambda acc, n: F.struct(
            (acc["t"] * x2 / (n.cast("double") + F.lit(0.5))).alias("t"),
            (acc["s"] + acc["t"] * x2 / (n.cast("double") + F.lit(0.5))).alias("s"),
        ),
        lambda acc: F.lit(1.0) - F.exp(-x2) * acc["s"],
    )
    cf = F.aggregate(
        F.sequence(F.lit(_CF_TERMS), F.lit(1), F.lit(-1)),
        x,
        lambda f, k: x + (k.cast("double") / F.lit(2.0)) / f,
        lambda f: F.exp(-x2) * F.lit(_INV_SQRT_PI) / f,
    )
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < F.lit(_SWITCH), series).otherwise(cf)


def normal_two_sided_p(z: Col) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2); |z| = inf gives 0, NaN/null give null."""
    z = _c(z)
    az = F.abs(z)
    return (F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double"))
            .when(az == F.lit(float("inf")), F.lit(0.0))
            .otherwise(erfc(az / F.lit(_SQRT2))))


# fixed values: ln(Gamma(x + 1/2) / Gamma(x)) = ln(x) / 2 + sum c / x^k for large x, as (k, c)
_HALF_STEP = [(1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432)]
_HALF_SHIFT = 16
_T_SERIES_TERMS = 160
_T_CF_TERMS = 150
_T_SWITCH = 2.5


def _log_gamma_step(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0: the asymptotic series at a + 16, stepped down."""
    x = a + F.lit(float(_HALF_SHIFT))
    out = F.log(x) / 2
    for k, c in _HALF_STEP:
        out = out + F.lit(c) / F.pow(x, F.lit(k))
    for i in range(_HALF_SHIFT):
        out = out - F.log1p(F.lit(0.5) / (a + F.lit(float(i))))
    return out


def student_two_sided_p(t: Col, df: Col) -> Column:
    """P(|T| > |t|) of Student's t with ``df`` > 0 degrees of freedom (abs err ~1e-13).

    It is the regularised incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2). For small t
    one less the series of the other side, whose terms are all positive; else the continued fraction
    of this side, evaluated from the tail. |t| = inf gives 0; NaN, null or df <= 0 give null."""
    t, df = F.abs(_c(t).cast("double")), _c(df).cast("double")
    a, y = df / 2, t * t / (df + t * t)
    x = df / (df + t * t)
    # y^(1/2) x^a / B(1/2, a), with B(1/2, a) = sqrt(pi) Gamma(a) / Gamma(a + 1/2)
    front = F.sqrt(y) * F.exp(a * F.log1p(-y) + _log_gamma_step(a)) * F.lit(_INV_SQRT_PI)
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(_T_SERIES_TERMS - 1)),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, n: F.struct(
            (acc["t"] * y * (a + n.cast("double") + F.lit(0.5)) / (n.cast("double") + F.lit(1.5))).alias("t"),
            (acc["s"] + acc["t"]).alias("s")),
        lambda acc: F.lit(1.0) - F.lit(2.0) * front * acc["s"],
    )

    def step(f, k):  # coefficients of the fraction of I_x(a, 1/2) in pairs, the last first
        m = k.cast("double")
        even = m * (F.lit(0.5) - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + F.lit(0.5) + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.lit(1.0) + even / (F.lit(1.0) + odd / f)

    tail = F.aggregate(F.sequence(F.lit(_T_CF_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), step,
                       lambda f: front / a / (F.lit(1.0) - (a + F.lit(0.5)) * x / (a + 1) / f))
    none = t.isNull() | F.isnan(t) | df.isNull() | F.isnan(df) | (df <= 0)
    small = (x >= (a + 1) / (a + 2.5)) | ((t < F.lit(_T_SWITCH)) & (a > 5))
    return (F.when(none, F.lit(None).cast("double")).when(t == F.lit(float("inf")), F.lit(0.0))
            .when(small, series).otherwise(tail))


def z_score(estimate: Col, std_err: Col) -> Column:
    """estimate / std_err; a zero std_err gives +-inf for a non-zero estimate, else null."""
    est, se = _c(estimate), _c(std_err)
    return (F.when(se > 0, est / se)
            .when((se == 0) & (est > 0), F.lit(float("inf")))
            .when((se == 0) & (est < 0), F.lit(float("-inf"))))


def round_doubles(df, places: int = 6):
    """Round every double column (report output: sums in another order differ in the last bits)."""
    from pyspark.sql import types as T
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])
