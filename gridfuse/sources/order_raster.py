"""Rasters derived from the ``orders`` table.

The given tables hold no images.  ``orders`` has dense keys, so a raster line is
``WIDTH`` consecutive keys; the last line is as long as the keys that are left,
and every order is one cell.  The lines fall into scenes that double in size,
so the last scene always holds a large part of all lines.  ``truth`` is the fine
image at the wanted date; it serves to judge a fusion and is never its input.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridfuse.schema import BANDS

WIDTH = 128
FIRST_SCENE = 60  # lines; scene k has FIRST_SCENE * 2**k
BLOCK = 5  # side of a coarse cell, in fine cells
PATCH = 8  # side of a land patch

# Change of the four land classes up to the wanted date.
CHANGE_TO_TARGET = (10, 90, 40, 180)


def _block_mean(value: str, block) -> Column:
    total = F.sum(value).over(block)
    return F.floor(total / F.count(F.lit(1)).over(block)).cast("int")


def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell: line key, column, the five bands, ``cls`` and ``truth``.

    Coarse blocks and lines both lie inside a band of ``BLOCK`` lines, so the
    one exchange on ``line_band`` serves the block means here and the line
    assembly in :func:`raster_stack`.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    placed = (
        orders.withColumn("line", F.expr(f"o_orderkey div {WIDTH}"))
        .withColumn("step", F.length(F.bin(F.expr(f"line div {FIRST_SCENE} + 1"))) - 1)
        .select(
            F.concat(F.lit("s"), F.col("step")).alias("scene"),
            F.expr(f"cast(line - {FIRST_SCENE} * (shiftleft(1L, step) - 1) as int)").alias(
                "row_key"
            ),
            (F.col("o_orderkey") % WIDTH).cast("int").alias("col"),
            (F.floor("o_totalprice") % 41 - 20).cast("int").alias("noise"),
            (F.col("o_custkey") % 7).cast("int").alias("cust7"),
            (F.col("o_custkey") % 5).cast("int").alias("cust5"),
            (F.col("o_orderkey") % 97 == 0).alias("no_data"),
        )
        .withColumn("cls", F.expr(f"cast((row_key div {PATCH} + col div {PATCH}) % 4 as int)"))
    )

    base = F.lit(400) + F.lit(300) * F.col("cls") + F.col("noise")
    change = F.element_at(F.array(*[F.lit(c) for c in CHANGE_TO_TARGET]), F.col("cls") + 1)
    fine = placed.select(
        "scene",
        F.expr(f"row_key div {BLOCK}").alias("line_band"),
        F.expr(f"col div {BLOCK}").alias("block_col"),
        "row_key",
        "col",
        "cls",
        F.when(F.col("no_data"), 0).otherwise(base).alias("fine1"),
        (base + 50 * (F.col("cls") + 1) + F.col("cust7")).alias("fine2"),
        (base + change + F.col("cust5")).alias("truth"),
    ).repartition("scene", "line_band")

    block = Window.partitionBy("scene", "line_band", "block_col")
    return fine.select(
        "scene",
        "line_band",
        "row_key",
        "col",
        "cls",
        "fine1",
        "fine2",
        _block_mean("fine1", block).alias("coarse1"),
        _block_mean("fine2", block).alias("coarse2"),
        _block_mean("truth", block).alias("coarse0"),
        "truth",
    )


def raster_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters as STACK: one row per line, five arrays in column order."""
    line = F.sort_array(F.collect_list(F.struct("col", *BANDS)))
    lines = (
        raster_cells(spark, sf_dir)
        .groupBy("scene", "line_band", "row_key")
        .agg(line.alias("cells"))
    )
    return lines.select(
        "scene", "row_key", *[F.col("cells").getField(b).alias(b) for b in BANDS]
    )


def raster_image(spark: SparkSession, sf_dir: str, band: str) -> DataFrame:
    """One band as an image of its own, in RASTER_ROWS layout."""
    line = F.sort_array(F.collect_list(F.struct("col", band)))
    return (
        raster_cells(spark, sf_dir)
        .groupBy("scene", "line_band", "row_key")
        .agg(line.alias("cells"))
        .select("scene", F.lit(band).alias("band"), "row_key",
                F.col("cells").getField(band).alias("pixels"))
    )
