"""The registered queries: each operator on the rasters of the ``orders`` table.

Results are scalar columns; a line of cells is given as text.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.functions import packing, window_fusion
from gridfuse.functions.pixels import cell_at, to_digital_number
from gridfuse.operators import layout, neighborhood, predict, regression, similarity, stats
from gridfuse.plans import fuse as fusion
from gridfuse.schema import BANDS, LINE_KEY, Grid
from gridfuse.sources import order_raster, store, wide

# Small tiles, so that small rasters have tile edges in both directions too.
TILES = Grid(tile_rows=32, tile_cols=64)
STRIPS = Grid(tile_rows=32, tile_cols=None)
CELL = ["scene", "row_key", "col"]
OFFSET = ["dr", "dc"]


def _text(pixels) -> Column:
    return F.array_join(F.col(pixels).cast("array<string>"), ",")


def _scaled(value, factor: int) -> Column:
    """A real number in units of ``1/factor``."""
    return F.round(value * factor).cast("bigint")


def _scaled_text(pixels, factor: int) -> Column:
    units = F.transform(pixels, lambda x: _scaled(x.cast("double"), factor))
    return F.array_join(units.cast("array<string>"), ",")


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_raster.raster_stack(spark, sf_dir)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stack_to_lines(_stack(spark, sf_dir))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhood.tile_stack_with_limits(_stack(spark, sf_dir), grid=TILES)


def _single_image(spark: SparkSession, sf_dir: str, band: str) -> DataFrame:
    """All scenes below each other as one image, as a wide file holds one."""
    first = order_raster.FIRST_SCENE
    step = F.substring("scene", 2, 9).cast("int")
    start = ((F.pow(F.lit(2), step) - 1) * first).cast("int")
    image = order_raster.raster_image(spark, sf_dir, band)
    return image.withColumn("row_key", F.col("row_key") + start)


def _wide(spark: SparkSession, sf_dir: str, band: str) -> DataFrame:
    return wide.wide_from_rows(_single_image(spark, sf_dir, band), order_raster.WIDTH)


# Sources and sinks


def rows_from_wide(spark, sf_dir):
    rows = wide.rows_from_wide(_wide(spark, sf_dir, "fine1"), "fine1", "s0")
    return rows.select("scene", "band", "row_key", _text("pixels").alias("cells"))


def write_roundtrip(spark, sf_dir):
    path = store.shared_folder(spark)
    store.write_wide(_wide(spark, sf_dir, "fine1"), path)
    rows = wide.read_image(spark, path, "fine1", "s0")
    return rows.select("scene", "band", "row_key", _text("pixels").alias("cells"))


def fusion_job(spark, sf_dir):
    """Five wide files in, one fused image out."""
    base = store.shared_folder(spark)
    paths = {b: f"{base}/{b}" for b in BANDS}
    for band, path in paths.items():
        store.write_wide(_wide(spark, sf_dir, band), path)
    fused = fusion.fuse(wide.read_images(spark, **paths), grid=STRIPS)
    return fused.select("scene", "row_key", _scaled_text("pixels", 1_000_000).alias("cells"))


def raster_shape(spark, sf_dir):
    return stats.raster_shape(_lines(spark, sf_dir))


def first_row(spark, sf_dir):
    row = stats.first_row(_stack(spark, sf_dir))
    return row.select(*LINE_KEY, *[_text(b).alias(b) for b in BANDS])


# Projections


def truncate_pixels(spark, sf_dir):
    """Order totals around zero, some of them no number or out of range."""
    key = F.col("o_orderkey")
    value = (
        F.when(key % 50 == 0, F.lit(float("nan")))
        .when(key % 51 == 0, F.lit(1e20))
        .when(key % 52 == 0, F.lit(None))
        .otherwise(F.col("o_totalprice") - 250000)
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", to_digital_number(value).alias("px"))


def pack_rows(spark, sf_dir):
    packed = _stack(spark, sf_dir).select(
        *LINE_KEY, packing.pack_line("fine1", "row_key").alias("value")
    )
    return packed.select(*LINE_KEY, F.hex("value").alias("value"))


def unpack_rows(spark, sf_dir):
    packed = _stack(spark, sf_dir).select(
        "scene", packing.pack_line("fine2", "row_key").alias("value")
    )
    lines = packed.select(
        "scene",
        packing.packed_line_number("value").alias("row_key"),
        packing.unpack_line("value").alias("pixels"),
    )
    return lines.select(*LINE_KEY, _text("pixels").alias("cells"))


def pixels_long(spark, sf_dir):
    return layout.pixels_long(_stack(spark, sf_dir))


def pack_unpack_nulls(spark, sf_dir):
    """Null lines stay null through packing; a null cell is no-data."""
    cells = F.transform("fine1", lambda px, at: F.when(at % 11 != 0, px))
    holed = _stack(spark, sf_dir).select(
        *LINE_KEY, F.when(F.col("row_key") % 7 != 0, cells).alias("pixels")
    )
    lines = packing.unpack_rows(packing.pack_rows(holed))
    return lines.select(*LINE_KEY, _text("pixels").alias("cells"))


def single_cell(spark, sf_dir):
    """One cell of each line, for some lines beyond their end."""
    col = F.col("row_key") * 3 % 160
    return _stack(spark, sf_dir).select(*LINE_KEY, cell_at("fine1", col).alias("px"))


# Joins and layout


def assemble_stack(spark, sf_dir):
    images = {b: order_raster.raster_image(spark, sf_dir, b) for b in BANDS}
    stack = layout.assemble_stack(**images)
    return stack.select(*LINE_KEY, *[_text(b).alias(b) for b in BANDS])


def lines_to_stack(spark, sf_dir):
    stack = layout.lines_to_stack(_lines(spark, sf_dir))
    return stack.select(*LINE_KEY, *[_text(b).alias(b) for b in BANDS])


def range_layout(spark, sf_dir):
    laid = layout.range_layout(_stack(spark, sf_dir))
    return laid.select(*LINE_KEY, F.size("fine1").alias("n_cells"))


def range_layout_order(spark, sf_dir):
    """Lines, partitions that overlap the one before, lines out of order in a partition."""
    laid = layout.range_layout(_stack(spark, sf_dir), 20).select(
        F.struct(*LINE_KEY).alias("line"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    before = F.lag("line").over(Window.partitionBy("part").orderBy("place"))
    lines = laid.withColumn("late", (F.col("line") < before).cast("int"))
    parts = lines.groupBy("part").agg(
        F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"),
        F.sum("late").alias("late"),
    )
    above = F.lag("high").over(Window.orderBy("part"))  # a row per partition
    return parts.withColumn("overlap", (F.col("low") < above).cast("int")).agg(
        F.sum("n").alias("n_lines"),
        F.coalesce(F.sum("overlap"), F.lit(0)).alias("n_overlapping"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("n_unsorted"),
    )


# Image statistics


def image_mean(spark, sf_dir):
    means = stats.image_mean(_lines(spark, sf_dir))
    return means.select("scene", "band", F.round("mean", 6).alias("mean"))


def image_stddev(spark, sf_dir):
    spreads = stats.image_stddev(_lines(spark, sf_dir))
    return spreads.select("scene", "band", F.round("stddev", 6).alias("stddev"))


def similarity_threshold(spark, sf_dir):
    return stats.similarity_threshold(_lines(spark, sf_dir))


# Neighbourhood


def window_rows(spark, sf_dir):
    windows = neighborhood.window_rows(_stack(spark, sf_dir), TILES)
    return windows.select(*LINE_KEY, "n_lines", "base_key", _text("keys").alias("keys"))


def line_in_window(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), STRIPS)
    lines = neighborhood.line_at(tiles, 3, "coarse0", STRIPS)
    return lines.select(*LINE_KEY, _text("pixels").alias("cells"))


def neighbors(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), TILES)
    return neighborhood.neighbors(tiles, TILES).drop("tile_row", "tile_col")


def window_sums(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), TILES)
    return neighborhood.window_sums(tiles, TILES).drop("tile_row", "tile_col")


def window_sums_ragged(spark, sf_dir):
    """Lines of rising and falling length."""
    length = 128 - F.col("row_key") * 7 % 50
    ragged = _stack(spark, sf_dir)
    for band in BANDS:
        ragged = ragged.withColumn(band, F.slice(band, F.lit(1), length))
    tiles = neighborhood.tile_stack(ragged, TILES)
    return neighborhood.window_sums(tiles, TILES).drop("tile_row", "tile_col")


# Similar cells and weights


def _similar(spark, sf_dir):
    near = neighborhood.neighbors(_limited(spark, sf_dir), TILES)
    return similarity.similar_pixels(near)


def similar_pixels(spark, sf_dir):
    return _similar(spark, sf_dir).drop("tile_row", "tile_col")


def spectral_corr(spark, sf_dir):
    return similarity.spectral_corr(_similar(spark, sf_dir)).select(*CELL, *OFFSET, "r")


def spatial_distance(spark, sf_dir):
    found = similarity.spatial_distance(_similar(spark, sf_dir), TILES)
    return found.select(*CELL, *OFFSET, F.round("d", 6).alias("d"))


def weights(spark, sf_dir):
    found = similarity.weights(_similar(spark, sf_dir), TILES)
    return found.select(*CELL, *OFFSET, F.round("w", 6).alias("w"))


# Prediction


def _sums(spark, sf_dir, slope="coarse_on_fine"):
    near = neighborhood.neighbors(_limited(spark, sf_dir), TILES, centre=True)
    return predict.pixel_sums(near, slope, TILES)


def conversion_slope(spark, sf_dir):
    found = predict.conversion_slope(_sums(spark, sf_dir))
    return found.select(*CELL, "n_similar", F.round("v", 6).alias("v"))


def temporal_weights(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), TILES)
    found = predict.temporal_weights(neighborhood.window_sums(tiles, TILES))
    return found.select(*CELL, "tm", "tn")


def temporal_weights_zero(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), TILES)
    found = predict.temporal_weights(neighborhood.window_sums(tiles, TILES), "zero")
    return found.select(*CELL, "tm", "tn")


def date_predictions(spark, sf_dir):
    found = predict.date_predictions(_sums(spark, sf_dir))
    return found.select(
        *CELL, F.round("pred_m", 4).alias("pred_m"), F.round("pred_n", 4).alias("pred_n")
    )


# The fusion


def _fused_cells(fused: DataFrame) -> DataFrame:
    cells = fused.select(*LINE_KEY, F.posexplode("pixels").alias("col", "value"))
    return cells.select(*CELL, F.round("value", 6).alias("fused"))


def fused(spark, sf_dir):
    return _fused_cells(fusion.fuse(_stack(spark, sf_dir), grid=TILES))


def fused_expr(spark, sf_dir):
    return _fused_cells(fusion.fuse(_stack(spark, sf_dir), grid=TILES, engine="expr"))


def fused_large_values(spark, sf_dir):
    """Every cell with data raised by twenty million."""
    raised = _stack(spark, sf_dir)
    for band in BANDS:
        up = F.transform(band, lambda px: F.when(px != 0, px + 20_000_000).otherwise(0))
        raised = raised.withColumn(band, up)
    cells = fusion.fuse(raised, grid=TILES).select(
        *LINE_KEY, F.posexplode("pixels").alias("col", "value")
    )
    return cells.select(*CELL, F.round("value", 4).alias("fused"))


def fused_extreme_values(spark, sf_dir):
    """Cells stretched over nearly the whole range of int, in units of a thousand."""
    wide_range = _stack(spark, sf_dir)
    for band in BANDS:
        far = F.transform(band, lambda px: F.when(px != 0, (px - 950) * 3_300_000).otherwise(0))
        wide_range = wide_range.withColumn(band, far)
    cells = fusion.fuse(wide_range, grid=TILES).select(
        *LINE_KEY, F.posexplode("pixels").alias("col", "value")
    )
    return cells.select(*CELL, F.round(F.col("value") / 1000).cast("bigint").alias("fused"))


def fused_published_slope(spark, sf_dir):
    stack = _stack(spark, sf_dir)
    return _fused_cells(fusion.fuse(stack, slope="fine_on_coarse", grid=TILES))


def fused_zero_change(spark, sf_dir):
    return _fused_cells(fusion.fuse(_stack(spark, sf_dir), zero_change="zero", grid=TILES))


def fused_six_classes(spark, sf_dir):
    return _fused_cells(fusion.fuse(_stack(spark, sf_dir), num_class=6, grid=TILES))


def fused_rows(spark, sf_dir):
    rows = fusion.fused_rows(fusion.fuse(_stack(spark, sf_dir), grid=STRIPS))
    return rows.select(*LINE_KEY, _scaled_text("pixels", 1_000_000).alias("cells"))


def fused_packed(spark, sf_dir):
    whole = fusion.fuse(_stack(spark, sf_dir), grid=STRIPS)
    packed = whole.select(*LINE_KEY, packing.pack_fused("pixels").alias("final_pixels"))
    lines = packed.select(*LINE_KEY, packing.unpack_fused("final_pixels").alias("pixels"))
    return lines.select(*LINE_KEY, _scaled_text("pixels", 1_000_000).alias("cells"))


def fused_packed_tiles(spark, sf_dir):
    """Packed lines in and out, so that cells move as bytes all the way."""
    lines = packing.pack_rows(_lines(spark, sf_dir))
    whole = fusion.fuse(lines, grid=TILES, packed=True)
    lines = whole.select(*LINE_KEY, packing.unpack_fused("pixels").alias("pixels"))
    return lines.select(*LINE_KEY, _scaled_text("pixels", 1_000_000).alias("cells"))


def fused_preview(spark, sf_dir):
    """The first twenty lines; no others are fused."""
    shown = fusion.fuse_preview(_stack(spark, sf_dir), grid=STRIPS)
    return shown.select(*LINE_KEY, _scaled_text("pixels", 1_000_000).alias("cells"))


def fused_by_sql(spark, sf_dir):
    """The fusion as an aggregate over a SQL window."""
    window_fusion.register_fusion(spark, "fuse_line")
    strips = neighborhood.tile_stack_with_limits(_stack(spark, sf_dir), grid=STRIPS)
    fused = spark.sql(
        """SELECT scene, row_key, tile_row,
                  fuse_line(row_key, fine1, fine2, coarse1, coarse2, coarse0, t1, t2)
                    OVER (PARTITION BY scene, tile_row, tile_col ORDER BY row_key
                          RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS pixels
           FROM {strips}""",
        strips=strips,
    )
    return _fused_cells(fused.where(layout.owner_row(STRIPS) == F.col("tile_row")))


def fused_by_group(spark, sf_dir):
    """The fusion as an aggregate of tiles, cut in both directions."""
    window_fusion.register_tile_fusion(spark, "fuse_tile", grid=TILES)
    tiles = spark.sql(
        """SELECT scene, tile_col, inline(lines) FROM (
             SELECT scene, tile_row, tile_col,
                    fuse_tile(tile_row, row_key, fine1, fine2, coarse1, coarse2, coarse0, t1, t2)
                      AS lines
             FROM {tiles} GROUP BY scene, tile_row, tile_col)""",
        tiles=_limited(spark, sf_dir),
    )
    return _fused_cells(fusion.join_parts(tiles))


def fused_with_moments(spark, sf_dir):
    """Lines and their sums stored; thresholds from the sums, without a second read of cells."""
    path = store.shared_folder(spark)
    store.write_lines(_lines(spark, sf_dir), f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    store.write_moments(lines, f"{path}/moments", TILES)
    moments = store.read_moments(spark, f"{path}/moments")
    return _fused_cells(fusion.fuse(lines, grid=TILES, moments=moments))


def tiles_in_box(spark, sf_dir):
    """Lines 40 to 90, columns 20 to 70 of every scene, from tiles stored along a curve."""
    path = store.shared_folder(spark)
    cut = layout.cut_tiles(_stack(spark, sf_dir), BANDS, TILES)
    store.write_tiles(cut, path, 16)
    held = spark.read.parquet(path).where(layout.in_box(40, 90, 20, 70, TILES))
    own = held.where(layout.owner_row(TILES) == F.col("tile_row"))
    at = F.col("at") + F.col("tile_col") * TILES.tile_cols
    cells = own.select(
        *LINE_KEY, "tile_col", F.posexplode(F.slice("fine1", F.lit(1), F.lit(TILES.tile_cols))).alias("at", "fine1")
    )
    cells = cells.select(*LINE_KEY, at.cast("int").alias("col"), "fine1")
    return cells.where("row_key between 40 and 90 and col between 20 and 70")


def rows_from_very_wide(spark, sf_dir):
    rows = wide.transposed_rows(_wide(spark, sf_dir, "fine1"), "fine1", "s0")
    return rows.select("scene", "band", "row_key", _text("pixels").alias("cells"))


# Regression


def _patches(spark, sf_dir):
    cells = layout.pixels_long(_stack(spark, sf_dir))
    patch = order_raster.PATCH
    return cells.select(
        "scene",
        F.expr(f"row_key div {patch}").alias("patch_row"),
        F.expr(f"col div {patch}").alias("patch_col"),
        "row_key",
        "col",
        "fine1",
        "coarse1",
    )


PATCH_KEY = ["scene", "patch_row", "patch_col"]


def regression_fit(spark, sf_dir):
    fit = regression.regression_fit(_patches(spark, sf_dir), "fine1", "coarse1", PATCH_KEY)
    return fit.select(
        *PATCH_KEY,
        F.round("intercept", 5).alias("intercept"),
        F.round("slope", 6).alias("slope"),
        "n",
    )


def regression_eval(spark, sf_dir):
    cells = _patches(spark, sf_dir)
    fit = regression.regression_fit(cells, "fine1", "coarse1", PATCH_KEY)
    fitted = regression.regression_eval(cells, fit, "fine1", PATCH_KEY)
    return fitted.select(*CELL, F.round("yhat", 6).alias("yhat"))


def regression_global(spark, sf_dir):
    """One line through all cells."""
    cells = layout.pixels_long(_stack(spark, sf_dir))
    fit = regression.regression_fit(cells, "fine1", "coarse1")
    fitted = regression.regression_eval(cells, fit, "fine1")
    return fitted.select(*CELL, F.round("yhat", 6).alias("yhat"))


def regression_few_points(spark, sf_dir):
    """Groups of one point, of one x, and a group without a key."""
    customer = F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.when(customer % 10 != 0, customer).alias("grp"),
        F.when(customer % 10 == 1, 7).otherwise(F.col("o_orderkey") % 100).alias("x"),
        (F.floor("o_totalprice") / 7.13).alias("y"),
    )
    fit = regression.regression_fit(orders, "x", "y", ["grp"])
    fitted = regression.regression_eval(orders, fit, "x", ["grp"])
    return fitted.select("o_orderkey", F.round("yhat", 4).alias("yhat"))


def image_without_key(spark, sf_dir):
    """Wide files of pixels only; a line's place in the files is its number."""
    path = store.shared_folder(spark)
    sheet = _wide(spark, sf_dir, "fine1").repartitionByRange(7, wide.INDEX_COLUMN)
    sheet = sheet.sortWithinPartitions(wide.INDEX_COLUMN)
    store.write_wide(sheet.drop(*sheet.columns[-2:]), path)
    rows = wide.read_unnumbered_image(spark, path, "fine1", "s0")
    return rows.select("scene", "band", "row_key", _text("pixels").alias("cells"))


def assemble_stored(spark, sf_dir):
    """Five images stored by line key, joined as they lie."""
    images = {}
    for band in BANDS:
        path = store.shared_folder(spark)
        table = "image_" + path.rsplit("/", 1)[-1]
        store.write_bucketed(order_raster.raster_image(spark, sf_dir, band), table, 8, path)
        images[band] = store.read_bucketed(spark, table)
    stack = layout.assemble_stack(**images)
    return stack.select(*LINE_KEY, *[_text(b).alias(b) for b in BANDS])


def block_sums(spark, sf_dir):
    tiles = neighborhood.tile_stack(_stack(spark, sf_dir), TILES)
    return neighborhood.block_sums(tiles, TILES).drop("tile_row", "tile_col")


QUERIES = {
    f.__name__: f
    for f in (
        rows_from_wide,
        write_roundtrip,
        fusion_job,
        raster_shape,
        first_row,
        truncate_pixels,
        pack_rows,
        unpack_rows,
        pixels_long,
        assemble_stack,
        lines_to_stack,
        range_layout,
        image_mean,
        image_stddev,
        similarity_threshold,
        window_rows,
        line_in_window,
        neighbors,
        window_sums,
        similar_pixels,
        spectral_corr,
        spatial_distance,
        weights,
        conversion_slope,
        temporal_weights,
        temporal_weights_zero,
        date_predictions,
        fused,
        fused_expr,
        fused_published_slope,
        fused_zero_change,
        fused_six_classes,
        fused_rows,
        fused_packed,
        fused_packed_tiles,
        fused_preview,
        fused_by_sql,
        fused_by_group,
        fused_with_moments,
        tiles_in_box,
        rows_from_very_wide,
        regression_fit,
        regression_eval,
        fused_large_values,
        fused_extreme_values,
        pack_unpack_nulls,
        window_sums_ragged,
        single_cell,
        range_layout_order,
        image_without_key,
        assemble_stored,
        block_sums,
        regression_global,
        regression_few_points,
    )
}
