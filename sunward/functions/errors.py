"""Error metrics as aggregate columns.

Residuals are ``measured - expected``; only pairs where both sides are
finite and the optional mask holds take part, and every metric stays NULL
when it is undefined.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .values import _c, finite, holds


@dataclass(frozen=True)
class Normalization:
    """An explicit denominator and the words that justify it."""

    value: float
    basis: str

    def __post_init__(self):
        if not (self.value > 0 and self.value < float("inf")):
            raise ValueError("a normalisation value must be finite and positive")
        if not self.basis.strip():
            raise ValueError("a normalisation basis must be stated")


class Pair:
    """Expected/measured columns restricted to usable pairs."""

    def __init__(self, expected, measured, mask: Column | None = None):
        e, m = finite(_c(expected)), finite(_c(measured))
        usable = e.isNotNull() & m.isNotNull()
        if mask is not None:
            usable = usable & holds(mask)
        self.usable = usable
        self.expected = F.when(usable, e)
        self.measured = F.when(usable, m)
        self.residual = F.when(usable, m - e)

    def count(self) -> Column:
        return F.count(self.residual)

    def mae(self) -> Column:
        return F.avg(F.abs(self.residual))

    def rmse(self) -> Column:
        return F.sqrt(F.avg(self.residual * self.residual))

    def mbe(self) -> Column:
        return F.avg(self.residual)

    def r_squared(self) -> Column:
        """1 - SSE/SST about the measured mean; NULL for n < 2 or no spread."""
        n = F.count(self.residual)
        sst = F.var_pop(self.measured) * n
        sse = F.sum(self.residual * self.residual)
        return F.when((n >= 2) & (sst > 0), F.lit(1.0) - sse / sst)

    def correlation(self) -> Column:
        varied = (F.stddev_pop(self.expected) > 0) & (F.stddev_pop(self.measured) > 0)
        return F.when(varied, F.corr(self.expected, self.measured))

    def gain(self) -> Column:
        """Least-squares slope of measured on expected through the origin."""
        xx = F.sum(self.expected * self.expected)
        return F.when(xx > 0, F.sum(self.expected * self.measured) / xx)

    def metrics(self, prefix: str = "") -> list:
        return [
            self.count().alias(f"{prefix}n"),
            self.mae().alias(f"{prefix}mae"),
            self.rmse().alias(f"{prefix}rmse"),
            self.mbe().alias(f"{prefix}mbe"),
            self.r_squared().alias(f"{prefix}r_squared"),
        ]

    def sums(self) -> list:
        """Seven mergeable sums; addition over devices gives the fleet's."""
        r, m = self.residual, self.measured
        return [
            F.count(F.lit(1)).alias("total"),
            F.count(r).alias("n"),
            F.sum(F.abs(r)).alias("sum_abs"),
            F.sum(r * r).alias("sum_sq"),
            F.sum(r).alias("sum_r"),
            F.sum(m).alias("sum_m"),
            F.sum(m * m).alias("sum_mm"),
        ]


def metrics_from_sums() -> list:
    """Metrics out of summed :meth:`Pair.sums` columns."""
    total, n = F.sum("total"), F.sum("n")
    sst = F.sum("sum_mm") - F.sum("sum_m") * F.sum("sum_m") / F.when(n > 0, n)
    return [
        total.alias("total"),
        n.alias("n"),
        (total - n).alias("excluded"),
        (F.sum("sum_abs") / F.when(n > 0, n)).alias("mae"),
        F.sqrt(F.sum("sum_sq") / F.when(n > 0, n)).alias("rmse"),
        (F.sum("sum_r") / F.when(n > 0, n)).alias("mbe"),
        F.when((n >= 2) & (sst > 0), 1.0 - F.sum("sum_sq") / sst).alias("r_squared"),
    ]
