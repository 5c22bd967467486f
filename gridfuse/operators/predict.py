"""Conversion slope, predictions from each date and the fused value, per cell."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import stencil
from gridfuse.operators.neighborhood import NEAR
from gridfuse.operators.similarity import closeness, is_similar
from gridfuse.schema import PIXEL_KEY, Grid

SLOPES = ("coarse_on_fine", "fine_on_coarse")


def pixel_sums(near: DataFrame, slope: str = "coarse_on_fine", grid: Grid = Grid()) -> DataFrame:
    """All sums over the neighbourhood that a fused cell needs, in one aggregation.

    ``near`` is ``neighbors(..., centre=True)`` with thresholds; the centre
    row keeps cells without neighbours and adds the centre to the block sums.
    The rows are already distributed by tile, so nothing is shuffled.
    """
    if slope not in SLOPES:
        raise ValueError(f"unknown slope {slope!r}")
    # Relative to the cell itself: the slope is the same, and the numbers are smaller.
    fine, coarse = (
        [F.col(NEAR + kind + k).cast("bigint") - F.col(kind + "1") for k in "12"]
        for kind in ("fine", "coarse")
    )
    x, y = (fine, coarse) if slope == "coarse_on_fine" else (coarse, fine)
    to_m, to_n = (F.col(NEAR + "coarse0").cast("bigint") - F.col(NEAR + c) for c in ("coarse1", "coarse2"))
    similar = F.col("similar")

    def over_similar(value, empty=0):
        return F.coalesce(F.sum(F.when(similar, value)), F.lit(empty))

    def products(name, one, other):
        parts = zip(stencil.limbs(one[0], other[0]), stencil.limbs(one[1], other[1]))
        return [over_similar(m + n).alias(f"{name}_{at}") for at, (m, n) in zip(("high", "low"), parts)]

    return (
        near.withColumn("similar", is_similar())
        .withColumn("raw", F.when(F.col("similar"), closeness(grid)))
        .groupBy(*PIXEL_KEY)
        .agg(
            F.first("fine1").alias("fine1"),
            F.first("fine2").alias("fine2"),
            over_similar(F.lit(1)).alias("n_similar"),
            over_similar(x[0] + x[1]).alias("sx"),
            over_similar(y[0] + y[1]).alias("sy"),
            *products("sxy", x, y),
            *products("sxx", x, x),
            F.sum("raw").alias("sum_raw"),
            F.sum(F.col("raw") * to_m).alias("change_m"),
            F.sum(F.col("raw") * to_n).alias("change_n"),
            F.sum(NEAR + "coarse0").alias("tp"),
            F.sum(NEAR + "coarse1").alias("tkm"),
            F.sum(NEAR + "coarse2").alias("tkn"),
        )
    )


def conversion_slope(sums: DataFrame) -> DataFrame:
    """Add ``v``: the least-squares slope over the similar neighbours at both dates."""
    pairs = F.col("n_similar") * 2
    sxy, sxx = (stencil.from_limbs(F.col(f"{c}_high"), F.col(f"{c}_low")) for c in ("sxy", "sxx"))
    v = stencil.slope(pairs, F.col("sx"), F.col("sy"), sxy, sxx)
    return sums.withColumn("v", v)


def temporal_weights(sums: DataFrame, zero_change: str = "limit") -> DataFrame:
    """Add ``tm`` and ``tn``, the weights of the two dates."""
    block = [F.col(c) for c in ("tp", "tkm", "tkn")]
    return sums.withColumn("tm", stencil.temporal_weight_m(*block, zero_change)).withColumn(
        "tn", stencil.temporal_weight_n(*block, zero_change)
    )


def date_predictions(sums: DataFrame) -> DataFrame:
    """Add ``pred_m`` and ``pred_n``: the fine cell of a date plus the weighted coarse change.

    The weighted change is a quotient of two sums, which spares the
    normalised weights themselves.  A cell without similar neighbours keeps its value.
    """

    def change(column):
        return F.coalesce(F.col("v") * (F.col(column) / F.col("sum_raw")), F.lit(0.0))

    return (
        conversion_slope(sums)
        .withColumn("pred_m", F.col("fine1") + change("change_m"))
        .withColumn("pred_n", F.col("fine2") + change("change_n"))
    )


def fused_pixels(sums: DataFrame, zero_change: str = "limit") -> DataFrame:
    """``fused``, the cell at the wanted date, from the sums of its neighbourhood."""
    both = temporal_weights(date_predictions(sums), zero_change)
    value = F.col("tm") * F.col("pred_m") + F.col("tn") * F.col("pred_n")
    return both.select(*PIXEL_KEY, value.alias("fused"))
