"""Straight-line least squares, per group of a table."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_fit(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Intercept and slope of ``y`` on ``x`` per group.

    Both are null for fewer than two points and where ``x`` does not vary.  Without ``by``
    it is one line for the whole table.
    The sums are built before the shuffle, so a large group costs no more than a small one.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    points = df.where(both).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.regr_slope(y, x).alias("fitted"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
    )
    slope = F.when((F.col("n") >= 2) & (F.col("lo") < F.col("hi")), F.col("fitted"))
    return points.withColumn("slope", slope).select(
        *by,
        (F.col("mean_y") - F.col("slope") * F.col("mean_x")).alias("intercept"),
        "slope",
        "n",
    )


def regression_eval(df: DataFrame, fit: DataFrame, x: str, by=()) -> DataFrame:
    """Add ``yhat``, the fitted line of the group at ``x``; null where there is no line.

    Keys are compared null-safe, so a group without a key has its line too.  Without keys
    the fit is one row for the whole table.  Otherwise no broadcast is asked for: Spark
    sizes the table of fits and splits a hot group of the join.
    """
    keys = {c: f"_fit_{c}" for c in by}
    own = [F.col("intercept").alias("_fit_intercept"), F.col("slope").alias("_fit_slope")]
    lines = fit.select(*[F.col(c).alias(k) for c, k in keys.items()], *own)
    if keys:
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
        joined = df.join(lines, same, "left")
    else:
        joined = df.join(F.broadcast(lines), how="cross")
    yhat = F.col("_fit_intercept") + F.col("_fit_slope") * F.col(x)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], yhat.alias("yhat"))
