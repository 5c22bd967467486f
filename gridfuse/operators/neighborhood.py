"""The sliding neighbourhood: which lines and cells a cell looks at.

A tile is one window partition, so nothing here orders a whole image.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridfuse.functions.pixels import pixel_index
from gridfuse.operators.kernel import coarse_sums
from gridfuse.operators.layout import (
    cut_tiles,
    fine_lines,
    owner_row,
    spread_tiles,
    strips_of_line,
    tile_list,
)
from gridfuse.operators.stats import limits_from, scene_limits
from gridfuse.schema import BANDS, LINE_KEY, NUM_CLASS, TILE_KEY, Grid

NEAR = "near_"


def tile_stack(stack: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """STACK cut into tiles and distributed by tile."""
    return spread_tiles(cut_tiles(stack, BANDS, grid), grid)


def with_limits(
    tiles: DataFrame,
    images: DataFrame,
    num_class: int = NUM_CLASS,
    grid: Grid = Grid(),
    whole: DataFrame | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Add the similarity thresholds ``t1`` and ``t2`` to every tile.

    ``images`` is the STACK or RASTER_ROWS table that was cut, and ``whole`` that of all
    lines where only some were.  With stored ``moments`` no cell is read for the
    thresholds.  The join keeps the distribution of :func:`spread_tiles`.
    """
    if moments is not None:
        limits = limits_from(moments, num_class)
    else:
        limits = scene_limits(fine_lines(images if whole is None else whole), num_class, grid)
    return tiles.join(tile_list(images, limits, grid), TILE_KEY, "left")


def tile_stack_with_limits(
    stack: DataFrame, num_class: int = NUM_CLASS, grid: Grid = Grid()
) -> DataFrame:
    """STACK as tiles with the thresholds of its own fine images."""
    return with_limits(tile_stack(stack, grid), stack, num_class, grid)


def _owned(grid: Grid) -> Column:
    return owner_row(grid) == F.col("tile_row")


def _image_col(grid: Grid) -> Column:
    """Column number in the image of position ``at`` in a tile."""
    return (F.col("at") + F.col("tile_col") * (grid.tile_cols or 0)).alias("col")


def window_rows(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Per line: how many lines its window holds, the first of them, and their keys.

    The window is the line itself and the ``grid.halo`` keys after it; it
    shrinks at the lower edge and over missing lines.  Only keys are needed, so
    lines are cut into strips without their cells.
    """
    keys = rows.select(*LINE_KEY)
    strips = keys.withColumn("tile_row", F.explode(strips_of_line(grid)))
    w = Window.partitionBy("scene", "tile_row").orderBy("row_key").rangeBetween(0, grid.halo)
    return (
        strips.select(
            *LINE_KEY,
            "tile_row",
            F.count(F.lit(1)).over(w).alias("n_lines"),
            F.min("row_key").over(w).alias("base_key"),
            F.collect_list("row_key").over(w).alias("keys"),
        )
        .where(_owned(grid))
        .drop("tile_row")
    )


def _window_lines(tiles: DataFrame, columns, grid: Grid) -> DataFrame:
    """Owned lines of a tile, once per line of their window, as ``dr`` and a struct ``near``.

    ``lead`` counts lines, not keys; the test on the key keeps a line
    below a gap out of the window.
    """
    w = Window.partitionBy(*TILE_KEY).orderBy("row_key")
    line = F.struct("row_key", *columns)
    ahead = [f"ahead{k}" for k in range(1, grid.window)]
    held = tiles.select(
        "*",
        line.alias("ahead0"),
        *[F.lead(line, k).over(w).alias(a) for k, a in enumerate(ahead, 1)],
    ).where(_owned(grid))
    return (
        held.withColumn("near", F.explode(F.array("ahead0", *ahead)))
        .drop("ahead0", *ahead)
        .withColumn("dr", F.col("near.row_key") - F.col("row_key"))
        .where(F.col("dr") <= grid.halo)
    )


def line_at(tiles: DataFrame, dr: int, column: str, grid: Grid = Grid()) -> DataFrame:
    """One line of each window by its offset: ``scene, row_key, tile_col, pixels``."""
    return _window_lines(tiles, [column], grid).where(F.col("dr") == dr).select(
        *LINE_KEY, "tile_col", F.col("near").getField(column).alias("pixels")
    )


def neighbors(tiles: DataFrame, grid: Grid = Grid(), centre: bool = False) -> DataFrame:
    """Every cell with every cell of its forward neighbourhood that lies in the image.

    Gives ``dr``, ``dc``, the five centre values and the five neighbour values
    (``near_`` columns), and passes on ``t1``, ``t2`` where the tiles have
    them.  ``centre`` adds the cell itself, at ``dr = dc = 0``.  The row count is
    bounded by ``window**2`` per cell.
    """
    passed = [c for c in ("t1", "t2") if c in tiles.columns]
    at_near = F.col("at") + F.col("dc")
    pairs = (
        _window_lines(tiles, BANDS, grid)
        .withColumn("at", F.explode(pixel_index(BANDS[0], grid.tile_cols)))
        .withColumn("dc", F.explode(F.array(*[F.lit(k) for k in range(grid.window)])))
        .where(at_near < F.size(F.col("near").getField(BANDS[0])))
    )
    if not centre:
        pairs = pairs.where((F.col("dr") > 0) | (F.col("dc") > 0))
    return pairs.select(
        *TILE_KEY,
        "row_key",
        _image_col(grid),
        "dr",
        "dc",
        *passed,
        *[F.get(b, F.col("at")).alias(b) for b in BANDS],
        *[F.get(F.col("near").getField(b), at_near).alias(NEAR + b) for b in BANDS],
    )


def _dense_lines(lines: DataFrame, columns, grid: Grid) -> DataFrame:
    """Lines of a tile without gaps, all as long as the longest and ``grid.halo`` more.

    A line is followed by empty ones up to the next, and the last up to the lower edge of
    the tile with its halo.  ``length`` is the own length of a line, null for an added one.
    """
    tile = Window.partitionBy(*TILE_KEY)
    below = F.lead("row_key").over(tile.orderBy("row_key"))
    edge = (F.col("tile_row") + 1) * grid.tile_rows + grid.halo
    width = F.greatest(*[F.size(c) for c in columns])
    held = lines.select(
        *TILE_KEY,
        "row_key",
        *columns,
        F.size(columns[0]).alias("length"),
        (F.max(width).over(tile) + grid.halo).alias("width"),
        F.coalesce(below, edge).alias("below"),
    )
    filled = held.withColumn("key", F.explode(F.sequence("row_key", F.col("below") - 1)))
    own = F.col("key") == F.col("row_key")
    return filled.select(
        *TILE_KEY,
        F.col("key").alias("row_key"),
        "width",
        F.when(own, F.col("length")).alias("length"),
        *[F.when(own, F.col(c)).alias(c) for c in columns],
    )


def block_sums(tiles: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """:func:`window_sums` by column expressions, from summed-area tables of the tiles.

    Running sums down the columns, then along the lines; each block sum is four look-ups
    in them, two of ``lead`` and two of the row itself, so the cost does not depend on the
    window.  Both windows are sorts within the tiles as they are distributed.
    """
    names = {"coarse0": "tp", "coarse1": "tkm", "coarse2": "tkn"}
    lines = _dense_lines(tiles, list(names), grid)
    cells = lines.withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.col("width") - 1))
    ).select(
        *TILE_KEY, "row_key", "length", "at",
        *[F.coalesce(F.get(c, F.col("at")), F.lit(0)).cast("long").alias(c) for c in names],
    )

    def blocks(table: DataFrame, across, along) -> DataFrame:
        """Sums of each cell and the ``grid.halo`` that follow it ``along``."""
        order = Window.partitionBy(*TILE_KEY, across).orderBy(along)
        until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = table.select("*", *[F.sum(c).over(until).alias(f"{c}_until") for c in names])
        ahead = {c: F.lead(f"{c}_until", grid.halo).over(order) for c in names}
        return summed.withColumns(
            {c: ahead[c] - (F.col(f"{c}_until") - F.col(c)) for c in names}
        ).drop(*[f"{c}_until" for c in names])

    # Lines of the halo have no full window; nor are they owned, so they are left out.
    down = blocks(cells, "at", "row_key").where(_owned(grid) & F.col("length").isNotNull())
    both = blocks(down, "row_key", "at").where(F.col("at") < F.col("length"))
    if grid.tile_cols is not None:
        both = both.where(F.col("at") < grid.tile_cols)
    sums = [F.col(c).alias(name) for c, name in names.items()]
    return both.select(*TILE_KEY, "row_key", _image_col(grid), *sums)


def window_sums(tiles: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Sums of the three coarse images over the neighbourhood, the cell included.

    One array sum per tile; the lines are distributed by tile already and no cell is sorted.
    """

    def one_tile(table: pa.Table) -> pa.Table:
        rows, cols, sums = coarse_sums(table, grid)
        first = {c: table.column(c)[0] for c in TILE_KEY}
        image_cols = cols + first["tile_col"].as_py() * (grid.tile_cols or 0)
        return pa.table(
            {
                **{c: pa.repeat(value, len(rows)) for c, value in first.items()},
                "row_key": pa.array(rows, pa.int32()),
                "col": pa.array(image_cols, pa.int32()),
                **{name: pa.array(block) for name, block in zip(("tp", "tkm", "tkn"), sums)},
            }
        )

    kept = tiles.select(*TILE_KEY, "row_key", "coarse0", "coarse1", "coarse2")
    schema = (
        "scene string, tile_row int, tile_col int, row_key int, col int, "
        "tp long, tkm long, tkn long"
    )
    return kept.groupBy(*TILE_KEY).applyInArrow(one_tile, schema)
