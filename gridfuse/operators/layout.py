"""Assembling the stack of images and cutting it into overlapping tiles."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions.packing import CELL_BYTES, is_packed
from gridfuse.schema import BANDS, LINE_KEY, TILE_KEY, Grid


def assemble_stack(
    coarse0: DataFrame,
    fine1: DataFrame,
    fine2: DataFrame,
    coarse1: DataFrame,
    coarse2: DataFrame,
) -> DataFrame:
    """Inner join of five images on the line key, giving STACK.

    A line that one image lacks drops out and a repeated line multiplies, as
    in any inner join; :func:`repeated_lines` finds repeats.  Images stored
    by ``store.write_bucketed`` in as many buckets each join without a shuffle.
    """
    images = dict(coarse0=coarse0, fine1=fine1, fine2=fine2, coarse1=coarse1, coarse2=coarse2)
    named = [
        rows.select(*LINE_KEY, F.col("pixels").alias(band)) for band, rows in images.items()
    ]
    joined = reduce(lambda left, right: left.join(right, LINE_KEY), named)
    return joined.select(*LINE_KEY, *BANDS)


def stack_images(**images: DataFrame) -> DataFrame:
    """Five images as one RASTER_ROWS table, the input of a fusion.

    The alternative to :func:`assemble_stack` that shuffles nothing: the five
    lines of a key meet when the tiles are built, in the one exchange that the
    neighbourhood needs anyway.
    """
    if sorted(images) != sorted(BANDS):
        raise ValueError(f"expected the images {', '.join(BANDS)}")
    parts = [
        rows.select("scene", F.lit(band).alias("band"), "row_key", "pixels")
        for band, rows in images.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def stack_to_lines(stack: DataFrame, bands=BANDS) -> DataFrame:
    """STACK to RASTER_ROWS; a projection, nothing is shuffled."""
    entries = [F.struct(F.lit(b).alias("band"), F.col(b).alias("pixels")) for b in bands]
    return stack.select(*LINE_KEY, F.inline(F.array(*entries))).select(
        "scene", "band", "row_key", "pixels"
    )


def _sound(lines: DataFrame) -> DataFrame:
    """RASTER_ROWS without nulls: a null key or line is an error, a null cell is no-data."""
    key = F.coalesce("row_key", F.raise_error(F.lit("a line has no key")).cast("int"))
    kind = lines.schema["pixels"].dataType
    empty = F.raise_error(F.lit("a line has no cells")).cast(kind)
    pixels = F.coalesce("pixels", empty)
    if getattr(kind, "containsNull", False):
        # False only where no cell is null: a comparison in generated code for nearly all lines.
        full = F.coalesce(~F.array_contains("pixels", F.lit(-(2**31))), F.lit(False))
        filled = F.transform(pixels, lambda cell: F.coalesce(cell, F.lit(0)))
        pixels = F.when(full, F.col("pixels")).otherwise(filled)
    return lines.select("scene", "band", key.alias("row_key"), pixels.alias("pixels"))


def as_lines(images: DataFrame) -> DataFrame:
    """Images as RASTER_ROWS with the five bands only; takes STACK or RASTER_ROWS."""
    if "band" not in images.columns:
        return _sound(stack_to_lines(images))
    return _sound(images.where(F.col("band").isin(*BANDS)))


def fine_lines(images: DataFrame) -> DataFrame:
    """The two fine images as RASTER_ROWS; the other bands are not read."""
    if "band" not in images.columns:
        return _sound(stack_to_lines(images, ("fine1", "fine2")))
    return _sound(images.where(F.col("band").isin("fine1", "fine2")))


def line_keys(images: DataFrame) -> DataFrame:
    """The line keys of the images, taken from ``fine1``; no cell is read."""
    if "band" in images.columns:
        images = images.where(F.col("band") == "fine1")
    return images.select(*LINE_KEY)


def lines_to_stack(lines: DataFrame, keys=LINE_KEY) -> DataFrame:
    """RASTER_ROWS to STACK by grouping; lines that a band lacks drop out.

    A repeated line is an error here, since its copies could not be told
    apart, and so are bands of different length.
    """
    one = [
        F.first(F.when(F.col("band") == b, F.col("pixels")), ignorenulls=True).alias(b)
        for b in BANDS
    ]
    stack = lines.groupBy(*keys).agg(*one, F.count(F.lit(1)).alias("found"))
    complete = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in BANDS])
    even = reduce(lambda a, b: a & b, [F.size(b) == F.size(BANDS[0]) for b in BANDS[1:]])

    def fail(text):
        return F.raise_error(F.lit(text)).cast("boolean")

    usable = (
        F.when(F.col("found") > len(BANDS), fail("a line occurs more than once in a band"))
        .when(~complete, F.lit(False))
        .when(~even, fail("the five bands of a line differ in length"))
        .otherwise(F.lit(True))
    )
    return stack.where(usable).drop("found")


def repeated_lines(rows: DataFrame) -> DataFrame:
    """Lines that occur more than once in an image; empty for a sound input."""
    keys = [*LINE_KEY, *(["band"] if "band" in rows.columns else [])]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def pixels_long(stack: DataFrame) -> DataFrame:
    """STACK unpacked to one row per cell; a cell that one band lacks is 0 there."""
    cells = F.posexplode(F.arrays_zip(*BANDS)).alias("col", "cell")
    return stack.select(*LINE_KEY, cells).select(
        *LINE_KEY,
        "col",
        *[F.coalesce(F.col("cell").getField(b), F.lit(0)).alias(b) for b in BANDS],
    )


def line_width(df: DataFrame, column: str = "pixels") -> Column:
    """How many cells a line has, as an array or packed."""
    if is_packed(df, column):
        return (F.length(column) / CELL_BYTES).cast("int")
    return F.size(column)


def owner_row(grid: Grid, row_key="row_key") -> Column:
    return F.floor(F.col(row_key) / F.lit(grid.tile_rows)).cast("int")


def strips_of_line(grid: Grid) -> Column:
    """The strips that hold a line: its own and those whose last lines look at it."""
    topmost = F.floor((F.col("row_key") - grid.halo) / F.lit(grid.tile_rows)).cast("int")
    # No strip lies above line 0, unless keys are negative.
    topmost = F.when(F.col("row_key") < 0, topmost).otherwise(F.greatest(topmost, F.lit(0)))
    return F.sequence(topmost, owner_row(grid))


def _last_tile_col(width: Column, grid: Grid) -> Column:
    if grid.tile_cols is None:
        return F.lit(0)
    return F.floor(F.greatest(width - 1, F.lit(0)) / F.lit(grid.tile_cols)).cast("int")


def cut_tiles(df: DataFrame, columns, grid: Grid) -> DataFrame:
    """Copy every line into the tiles whose cells look at it.

    A cell looks at the lines below it and the columns to its right.  So a
    tile holds the cells it owns and ``grid.halo`` further lines and columns.
    The copies are the fraction ``halo/tile_rows + halo/tile_cols`` of the
    data, and a tile has a fixed largest size however large its scene is.
    Lines are arrays or packed.
    """
    columns = list(columns)
    packed = {c for c in columns if is_packed(df, c)}
    widths = [line_width(df, c) for c in columns]
    width = F.greatest(*widths) if len(widths) > 1 else widths[0]
    keep = [c for c in df.columns if c not in columns]
    cut = df.withColumn("tile_row", F.explode(strips_of_line(grid))).withColumn(
        "tile_col", F.explode(F.sequence(F.lit(0), _last_tile_col(width, grid)))
    )
    if grid.tile_cols is None:
        return cut
    before = F.col("tile_col") * grid.tile_cols
    held = grid.tile_cols + grid.halo

    def part(column):
        if column in packed:
            return F.substring(column, before * CELL_BYTES + 1, F.lit(held * CELL_BYTES))
        return F.slice(column, before + 1, F.lit(held))

    return cut.select(*keep, "tile_row", "tile_col", *[part(c).alias(c) for c in columns])


def tile_list(images: DataFrame, scenes: DataFrame, grid: Grid) -> DataFrame:
    """One row per tile with the values of its scene.

    ``scenes`` has one row per scene with its width ``n_cols``.  Only the line
    keys are read here.  Values of a scene thus reach the lines over the tile
    key, on which they are distributed anyway: no table of scenes is broadcast
    by force, and the lines of a large scene do not meet in one task.
    """
    strips = line_keys(images).select("scene", owner_row(grid).alias("tile_row")).distinct()
    last = _last_tile_col(F.col("n_cols"), grid)
    return (
        strips.join(scenes, "scene")
        .withColumn("tile_col", F.explode(F.sequence(F.lit(0), last)))
        .drop("n_cols")
    )


def spread_tiles(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Hash-distribute tiles; later joins, windows and groups on the tile key reuse it.

    The number of partitions is given explicitly, because adaptive execution
    would merge partitions that are small in bytes but heavy in arithmetic.
    """
    settings = tiles.sparkSession.conf
    n = grid.partitions or int(settings.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, *TILE_KEY)


def range_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition on the line key and sort inside the partitions.

    Without ``partitions`` Spark chooses their number from the size of the data.
    """
    number = [] if partitions is None else [partitions]
    return df.repartitionByRange(*number, *LINE_KEY).sortWithinPartitions(*LINE_KEY)


def _spread_bits(number: Column) -> Column:
    """The low 31 bits of a number, a zero after each: for numbers from 0 to 2**31 - 1."""
    # Masks of the usual doubling of gaps between bits.
    masks = (0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555)
    spread = number.cast("bigint")
    for shift, mask in zip((16, 8, 4, 2, 1), masks):
        spread = spread.bitwiseOR(F.shiftleft(spread, shift)).bitwiseAND(F.lit(mask))
    return spread


def curve_key(tile_row="tile_row", tile_col="tile_col") -> Column:
    """The place of a tile on the Z-order curve.  Rows and columns below 0 are shifted up."""
    row, col = (F.col(c).cast("bigint") for c in (tile_row, tile_col))
    low = 2**30
    return F.shiftleft(_spread_bits(row + low), 1).bitwiseOR(_spread_bits(col + low))


def curve_layout(tiles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tiles range-partitioned and sorted along the curve, scene by scene.

    Lines of a tile stay together unless a tile is larger than a partition.
    """
    number = [] if partitions is None else [partitions]
    order = ["scene", "_curve", "row_key"]
    placed = tiles.withColumn("_curve", curve_key())
    return placed.repartitionByRange(*number, *order).sortWithinPartitions(*order).drop("_curve")


def in_box(first_line: int, last_line: int, first_col: int, last_col: int, grid: Grid) -> Column:
    """The test for tiles that own cells of a box; in constants, so that it reaches the scan."""
    rows = F.col("tile_row").between(first_line // grid.tile_rows, last_line // grid.tile_rows)
    if grid.tile_cols is None:
        return rows
    return rows & F.col("tile_col").between(first_col // grid.tile_cols, last_col // grid.tile_cols)
