"""The whole fusion, from five images to the fused image."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions.packing import FLOAT_CELL, is_packed, pack_fused, to_blobs, unpack_rows
from gridfuse.operators.kernel import fuse_tile
from gridfuse.operators.layout import as_lines, cut_tiles, lines_to_stack, spread_tiles
from gridfuse.operators.neighborhood import neighbors, with_limits
from gridfuse.operators.predict import SLOPES, fused_pixels, pixel_sums
from gridfuse.schema import BANDS, LINE_KEY, NUM_CLASS, TILE_KEY, Grid


def _limited_tiles(
    images: DataFrame,
    num_class: int,
    grid: Grid,
    whole: DataFrame | None,
    moments: DataFrame | None,
) -> DataFrame:
    tiles = spread_tiles(cut_tiles(as_lines(images), ["pixels"], grid), grid)
    return with_limits(tiles, images, num_class, grid, whole, moments)


def _by_arrow(
    tiles: DataFrame, slope: str, zero_change: str, grid: Grid, packed: bool
) -> DataFrame:
    def one_tile(table: pa.Table) -> pa.Table:
        keys, ends, values = fuse_tile(table, grid, slope, zero_change)
        same = {
            c: pa.repeat(table.column(c)[0], len(keys)) for c in ("scene", "tile_col")
        }
        pixels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        if packed:
            pixels = to_blobs(pixels, FLOAT_CELL)
        return pa.table({**same, "row_key": pa.array(keys, pa.int32()), "pixels": pixels})

    cells = "binary" if packed else "array<double>"
    schema = f"scene string, tile_col int, row_key int, pixels {cells}"
    return tiles.groupBy(*TILE_KEY).applyInArrow(one_tile, schema)


def _by_expressions(
    tiles: DataFrame, slope: str, zero_change: str, grid: Grid, packed: bool
) -> DataFrame:
    if is_packed(tiles):
        tiles = unpack_rows(tiles)
    missing = F.raise_error(F.lit("no similarity threshold for this tile")).cast("double")
    for limit in ("t1", "t2"):
        tiles = tiles.withColumn(limit, F.coalesce(limit, missing))
    stack = lines_to_stack(tiles, [*TILE_KEY, "row_key", "t1", "t2"])
    near = neighbors(stack, grid, centre=True)
    cells = fused_pixels(pixel_sums(near, slope, grid), zero_change)
    line = F.sort_array(F.collect_list(F.struct("col", "fused")))
    parts = (
        cells.groupBy(*TILE_KEY, "row_key")
        .agg(line.alias("cells"))
        .select("scene", "tile_col", "row_key", F.col("cells.fused").alias("pixels"))
    )
    return parts.withColumn("pixels", pack_fused("pixels")) if packed else parts


def fuse_parts(
    images: DataFrame,
    num_class: int = NUM_CLASS,
    slope: str = "coarse_on_fine",
    zero_change: str = "limit",
    grid: Grid = Grid(),
    engine: str = "arrow",
    packed: bool = False,
    whole: DataFrame | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    """The fused image as parts of lines: ``scene, row_key, tile_col, pixels``.

    ``images`` is a STACK, or a RASTER_ROWS table with the five bands.  It is
    shuffled once, by tile; a second read of the two fine bands gives the thresholds.
    The pixels of RASTER_ROWS may be packed, which is the fastest input.
    ``engine`` is ``arrow`` (whole tiles in numpy) or ``expr`` (column
    expressions only); both give the same image.  ``packed`` gives the result
    as big-endian float32 blobs instead of arrays of double.  Where ``images`` holds only
    some lines, ``whole`` has all of them, for the thresholds; ``moments``, stored with the
    lines (``store.read_moments``), gives the thresholds without that second read.
    """
    if slope not in SLOPES:
        raise ValueError(f"unknown slope {slope!r}")
    if zero_change not in ("limit", "zero"):
        raise ValueError(f"unknown zero_change {zero_change!r}")
    engines = {"arrow": _by_arrow, "expr": _by_expressions}
    if engine not in engines:
        raise ValueError(f"unknown engine {engine!r}")
    tiles = _limited_tiles(images, num_class, grid, whole, moments)
    return engines[engine](tiles, slope, zero_change, grid, packed)


def fuse(
    images: DataFrame,
    num_class: int = NUM_CLASS,
    slope: str = "coarse_on_fine",
    zero_change: str = "limit",
    grid: Grid = Grid(),
    engine: str = "arrow",
    packed: bool = False,
    moments: DataFrame | None = None,
) -> DataFrame:
    """The fused image, one row per line: ``scene, row_key, pixels``.

    Uncut lines (``grid.tile_cols=None``) need no regrouping; otherwise the
    parts of each line meet in one further exchange of the result alone.
    """
    parts = fuse_parts(images, num_class, slope, zero_change, grid, engine, packed, moments=moments)
    if grid.tile_cols is None:
        return parts.select(*LINE_KEY, "pixels")
    return join_parts(parts)


def join_parts(parts: DataFrame) -> DataFrame:
    """Whole lines from the parts that column tiles left."""
    ordered = F.sort_array(F.collect_list(F.struct("tile_col", "pixels")))
    pieces = F.col("parts.pixels")
    if is_packed(parts):
        empty = F.lit(b"")
        line = F.aggregate(pieces, empty, lambda left, right: F.concat(left, right))
    else:
        line = F.flatten(pieces)
    return (
        parts.groupBy(*LINE_KEY)
        .agg(ordered.alias("parts"))
        .select(*LINE_KEY, line.alias("pixels"))
    )


def fused_rows(fused: DataFrame) -> DataFrame:
    """FUSED: lines of float32 cells, as they are stored."""
    return fused.select(*LINE_KEY, F.col("pixels").cast("array<float>").alias("pixels"))


def fused_preview(fused: DataFrame, lines: int = 20) -> DataFrame:
    """The first lines of a fused image that is there already; else :func:`fuse_preview`."""
    return fused.orderBy(*LINE_KEY).limit(lines)


def preview_keys(images: DataFrame, lines: int = 20) -> list[tuple[str, int]]:
    """The first line keys that all five bands have; only keys are read."""
    keys = images.select(*LINE_KEY)
    if "band" in images.columns:
        found = images.where(F.col("band").isin(*BANDS)).groupBy(*LINE_KEY)
        complete = found.agg(F.count_distinct("band").alias("bands"))
        keys = complete.where(F.col("bands") == len(BANDS)).select(*LINE_KEY)
    # A preview is shown, so its keys fit the driver: that is its only bound.
    first = keys.orderBy(*LINE_KEY).limit(lines).collect()
    return [(row["scene"], row["row_key"]) for row in first]


def key_ranges(keys, halo: int) -> list[tuple[str, int, int]]:
    """(scene, first, last) of the lines that the windows of the keys hold, merged."""
    merged: list[tuple[str, int, int]] = []
    for scene, key in keys:
        if merged and merged[-1][0] == scene and key <= merged[-1][2] + 1:
            merged[-1] = (scene, merged[-1][1], key + halo)
        else:
            merged.append((scene, key, key + halo))
    return merged


def _within(ranges):
    """The test on a line key, in constants, so that it reaches the scan."""
    tests = [
        F.col("scene").eqNullSafe(F.lit(scene)) & F.col("row_key").between(first, last)
        for scene, first, last in ranges
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def fuse_preview(
    images: DataFrame,
    lines: int = 20,
    num_class: int = NUM_CLASS,
    slope: str = "coarse_on_fine",
    zero_change: str = "limit",
    grid: Grid = Grid(),
    engine: str = "arrow",
) -> DataFrame:
    """The first lines of the fused image, by key, without fusing the others.

    The limit goes through the neighbourhood: the first ``lines`` keys are taken from the
    line keys, widened by the lines that their windows look at, and only those lines are
    read, cut and fused.  The thresholds come from the whole images of the scenes shown.
    """
    keys = preview_keys(images, lines)
    if any(key is None for _, key in keys):
        raise ValueError("a line has no key")
    ranges = key_ranges(keys, grid.halo)
    held = images.where(_within(ranges))
    scenes = sorted({scene for scene, _ in keys if scene is not None})
    whole = images.where(F.col("scene").isin(*scenes)) if scenes else images.limit(0)
    parts = fuse_parts(held, num_class, slope, zero_change, grid, engine, whole=whole)
    shown = parts.where(_within((scene, key, key) for scene, key in keys))
    fused = shown.select(*LINE_KEY, "pixels") if grid.tile_cols is None else join_parts(shown)
    return fused.orderBy(*LINE_KEY)
