"""Similar neighbours and their weights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridfuse.functions import stencil
from gridfuse.operators.neighborhood import NEAR
from gridfuse.schema import PIXEL_KEY, Grid


def is_similar() -> Column:
    """The test on a row of ``neighbors``; a cell is no neighbour of itself."""
    apart = (F.col("dr") > 0) | (F.col("dc") > 0)
    return apart & stencil.is_similar(
        F.col("t1"),
        F.col("t2"),
        F.col("fine1"),
        F.col("fine2"),
        F.col(NEAR + "fine1"),
        F.col(NEAR + "fine2"),
    )


def similar_pixels(near: DataFrame) -> DataFrame:
    """The neighbours that are similar to their centre at both dates."""
    return near.where(is_similar())


def neighbor_corr() -> Column:
    return stencil.correlation(*[F.col(NEAR + b) for b in ("fine1", "fine2", "coarse1", "coarse2")])


def spatial_distance(near: DataFrame, grid: Grid = Grid()) -> DataFrame:
    return near.withColumn("d", stencil.distance(F.col("dr"), F.col("dc"), grid.window))


def spectral_corr(near: DataFrame) -> DataFrame:
    return near.withColumn("r", neighbor_corr())


def closeness(grid: Grid) -> Column:
    """Inverse of the combined distance: a weight before it is normalised."""
    dist = stencil.distance(F.col("dr"), F.col("dc"), grid.window)
    return 1 / stencil.combined_distance(neighbor_corr(), dist)


def weights(similar: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Add ``w``, the weight of each similar neighbour; they sum to 1 per cell.

    The window is one cell's neighbourhood and finds its rows already
    distributed by tile.
    """
    cell = Window.partitionBy(*PIXEL_KEY)
    raw = similar.withColumn("raw", closeness(grid))
    return raw.withColumn("w", F.col("raw") / F.sum("raw").over(cell)).drop("raw")
