from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds (``x1:y1``, ``(x1^2)``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(c: Column, numeric: bool = True) -> Column:
    return c.isNull() | F.isnan(c) if numeric else c.isNull()


def weighted_mean(x: Column, w: Column | None) -> Column:
    return F.avg(x) if w is None else F.sum(w * x) / F.sum(w)


def log_likelihood(y: Column, p: Column) -> Column:
    """Natural log-likelihood of one row; 0 where a certain prediction is wrong about a class that cannot be scored."""
    certain = ((y == 0) & (p == 0)) | ((y == 1) & (p == 1))
    return F.when(certain, F.lit(0.0)).otherwise(y * F.log(p) + (1 - y) * F.log(1 - p))


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def x_log_x(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))


#: A rational approximation of the normal distribution's tail, of the order of 1e-14.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column | str) -> Column:
    """The standard normal distribution function, as an expression: Spark has no error function."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = F.abs(x)
    density = F.exp(-y * y / 2)

    def polynomial(values: tuple[float, ...]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * y + F.lit(v)
        return out

    fraction = y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))
    tail = F.when(y > 37, F.lit(0.0)).when(y < 7.07106781186547, density * polynomial(TAIL_TOP) / polynomial(TAIL_BOTTOM)).otherwise(density / (fraction * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def binary_smd(m0: Column, m1: Column, low: Column, high: Column) -> Column:
    """Standardised difference of a two-valued feature; infinite where the external mean is out of range."""
    width = high - low
    p0, p1 = (m0 - low) / width, (m1 - low) / width
    spread = F.sqrt((p0 * (1 - p0) + p1 * (1 - p1)) * width)
    return F.when((m0 < low) | (m0 > high), F.lit(float("inf"))).otherwise(F.abs(m1 - m0) / spread)


def continuous_smd(m0: Column, s0: Column, m1: Column, s1: Column) -> Column:
    """Standardised difference of a numeric feature from its mean and mean square on both sides."""
    return F.abs(m1 - m0) / F.sqrt((s0 - m0 * m0) + (s1 - m1 * m1))


def single_smd(m0: Column, m1: Column, s1: Column) -> Column:
    """Standardised difference of a numeric feature that has no square: its mean square less its mean stands for the variance."""
    return F.when(s1 > m1, F.abs(m1 - m0) / F.sqrt(2 * (s1 - m1))).when(s1 == m1, F.abs(m1 - m0) / F.sqrt(F.lit(0.001)))


def binary_from_normal(x: Column, mean: Column, sd: Column, frequency: Column) -> Column:
    """1 where the distribution function of x is below the wanted frequency."""
    return F.when(normal_cdf((x - mean) / sd) < frequency, 1).otherwise(0)
