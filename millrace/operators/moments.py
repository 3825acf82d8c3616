"""Sample skewness and kurtosis from Spark's population moments."""

from pyspark.sql import functions as F


def skew(c, n=None):
    n = F.count(c) if n is None else n
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(c, n=None):
    n = F.count(c) if n is None else n
    return F.when(n >= 4, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))
