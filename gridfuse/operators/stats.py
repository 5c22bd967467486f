"""Statistics of whole images."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions.packing import INT_CELL, blob_cells, is_packed
from gridfuse.operators.layout import line_width, owner_row
from gridfuse.schema import NUM_CLASS, Grid

_LOW_BITS = 2**32
_CELLS_AT_ONCE = 16_384


def raster_shape(rows: DataFrame) -> DataFrame:
    """Dimensions, lines, columns and cells of each image."""
    size = line_width(rows)
    return rows.groupBy("scene", "band").agg(
        F.lit(2).alias("n_dims"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(size).alias("n_cols"),
        F.sum(size).alias("n_cells"),
    )


def _spread(n, total, squares) -> Column:
    """Population standard deviation from exact sums, with one rounding at the end."""
    n = n.cast("decimal(20,0)")
    total = total.cast("decimal(19,0)")
    return F.sqrt((n * squares - total * total).cast("double")) / n.cast("double")


def _cell_sums(rows: DataFrame) -> DataFrame:
    """Count, sum and sum of squares per image and strip, from arrays of cells."""
    px = F.col("px").cast("bigint")
    cells = rows.select(
        "scene",
        "band",
        "tile_row",
        F.size("pixels").alias("n_cols"),
        F.explode("pixels").alias("px"),
    )
    return (
        cells.groupBy("scene", "band", "tile_row")
        .agg(
            F.max("n_cols").alias("n_cols"),
            F.count("px").alias("n"),
            F.sum(px).alias("total"),
            F.sum(F.shiftright(px * px, 32)).alias("high"),
            F.sum((px * px).bitwiseAND(F.lit(_LOW_BITS - 1))).alias("low"),
        )
    )


def _packed_sums(rows: DataFrame) -> DataFrame:
    """The same from packed lines, a batch of lines at a time."""
    sums = ("n", "total", "high", "low")

    def line_sums(batches):
        for batch in batches:
            cells, ends = blob_cells(batch.column("pixels"), INT_CELL)
            found = np.zeros((4, batch.num_rows), np.int64)
            found[0] = np.diff(ends)
            # A few lines at a time, so that the working arrays stay in cache.
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + _CELLS_AT_ONCE)))
                last = min(last, batch.num_rows)
                px = cells[ends[first] : ends[last]].astype(np.int64)
                square = px * px
                bounds = ends[first : last + 1] - ends[first]
                for k, values in enumerate((px, square >> 32, square & (_LOW_BITS - 1)), 1):
                    running = np.concatenate([[0], np.cumsum(values)])
                    found[k, first:last] = np.diff(running[bounds])
                first = last
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("scene", "band", "tile_row")),
                    pa.array(found[0], pa.int32()),
                    *(pa.array(v) for v in found),
                ],
                ["scene", "band", "tile_row", "n_cols", *sums],
            )

    schema = "scene string, band string, tile_row int, n_cols int, " + ", ".join(
        f"{c} bigint" for c in sums
    )
    return (
        rows.mapInArrow(line_sums, schema)
        .groupBy("scene", "band", "tile_row")
        .agg(F.max("n_cols").alias("n_cols"), *[F.sum(c).alias(c) for c in sums])
    )


def _strip_moments(rows: DataFrame, grid: Grid) -> DataFrame:
    """Exact sums per image and strip of lines.

    Squares are summed in two halves, which keeps bigint sums safe for the
    whole range of int.  Integer sums do not depend on the order of the data,
    so every run gives the same thresholds.
    """
    placed = rows.select("scene", "band", owner_row(grid).alias("tile_row"), "pixels")
    sums = _packed_sums(placed) if is_packed(rows) else _cell_sums(placed)
    squares = F.col("high").cast("decimal(20,0)") * F.lit(_LOW_BITS) + F.col("low")
    return sums.withColumn("squares", squares.cast("decimal(28,0)"))


def strip_moments(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Mergeable sums per image and strip: ``scene, band, tile_row, n_cols, n, total, squares``.

    Whole numbers, so sums of any parts of an image combine to those of the whole, exactly.
    ``store.write_lines(..., moments=True)`` keeps them beside the lines.
    """
    return _strip_moments(rows, grid).drop("high", "low")


def image_mean(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Mean of each image, no-data cells included."""
    mean = F.sum("total").cast("double") / F.sum("n")
    return _strip_moments(rows, grid).groupBy("scene", "band").agg(mean.alias("mean"))


def image_stddev(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Population standard deviation of each image, no-data cells included."""
    return (
        _strip_moments(rows, grid)
        .groupBy("scene", "band")
        .agg(_spread(F.sum("n"), F.sum("total"), F.sum("squares")).alias("stddev"))
    )


def similarity_threshold(
    rows: DataFrame, num_class: int = NUM_CLASS, grid: Grid = Grid()
) -> DataFrame:
    """Largest difference of similar cells at the two dates: ``scene, t1, t2``.

    Two standard deviations of the fine image over the number of land classes,
    rounded to 6 decimals.
    """
    return scene_limits(rows, num_class, grid).drop("n_cols")


def scene_limits(rows: DataFrame, num_class: int = NUM_CLASS, grid: Grid = Grid()) -> DataFrame:
    """The similarity thresholds and the width of each scene: ``scene, t1, t2, n_cols``."""
    fine = rows.where(F.col("band").isin("fine1", "fine2"))
    return limits_from(_strip_moments(fine, grid), num_class)


def limits_from(moments: DataFrame, num_class: int = NUM_CLASS) -> DataFrame:
    """The same from stored :func:`strip_moments`, without reading a cell."""

    def limit(band):
        n, total, squares = (
            F.sum(F.when(F.col("band") == band, F.col(c))) for c in ("n", "total", "squares")
        )
        return F.round(_spread(n, total, squares) * 2 / num_class, 6)

    return (
        moments.where(F.col("band").isin("fine1", "fine2"))
        .groupBy("scene")
        .agg(
            limit("fine1").alias("t1"),
            limit("fine2").alias("t2"),
            F.max("n_cols").alias("n_cols"),
        )
    )


def first_row(rows: DataFrame) -> DataFrame:
    """The first line of a table, by line key."""
    return rows.orderBy("scene", "row_key").limit(1)
