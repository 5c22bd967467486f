"""Cell-level column expressions, without Python."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_digital_number(value) -> Column:
    """A float cell as an int, truncated toward zero.

    NaN, null and values outside int are no-data, stored as 0.
    """
    cell = F.col(value) if isinstance(value, str) else value
    return F.coalesce(cell.try_cast("int"), F.lit(0))


def to_digital_numbers(line) -> Column:
    """The same for an array of float cells, with one cast for the whole line."""
    return F.transform(line.try_cast("array<int>"), lambda cell: F.coalesce(cell, F.lit(0)))


def cell_at(pixels, col) -> Column:
    """One cell of a line; a column outside the line gives 0."""
    index = F.lit(col) if isinstance(col, int) else col
    return F.coalesce(F.get(pixels, index), F.lit(0))


def pixel_index(pixels, owned: int | None = None) -> Column:
    """Column numbers of a line, of at most ``owned`` cells; empty for an empty line."""
    size = F.size(pixels) if owned is None else F.least(F.size(pixels), F.lit(owned))
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )
