"""Parquet output and the folder for tables that a job writes on its way."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridfuse.operators.layout import curve_layout, range_layout
from gridfuse.operators.stats import strip_moments
from gridfuse.schema import LINE_KEY, Grid


def write_wide(wide: DataFrame, path: str) -> None:
    """A wide table as gzip parquet without dictionaries."""
    (
        wide.write.option("compression", "gzip")
        .option("parquet.enable.dictionary", "false")
        .parquet(path)
    )


def write_lines(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Lines (RASTER_ROWS, STACK or FUSED) as parquet.

    RASTER_ROWS get one folder per band, so that the thresholds read the two
    fine bands only.  With ``partitions`` the lines are range-partitioned and
    sorted first, so that a later filter on scene or lines skips files by
    their statistics.
    """
    if partitions is not None:
        rows = range_layout(rows, partitions)
    writer = rows.write
    if "band" in rows.columns:
        writer = writer.partitionBy("band")
    writer.parquet(path)


def write_moments(rows: DataFrame, path: str, grid: Grid = Grid()) -> None:
    """The sums of every image and strip (``stats.strip_moments``), to lie beside its lines.

    Lines that are added later append their own: sums of parts combine to those of the whole.
    """
    strip_moments(rows, grid).write.mode("append").parquet(path)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """Stored sums, for the thresholds of a fusion (``fuse(..., moments=...)``)."""
    return spark.read.parquet(path)


def write_tiles(tiles: DataFrame, path: str, partitions: int) -> None:
    """Tiles in the order of a space-filling curve, so that a box of tiles reads few files.

    Neighbours in both directions are near each other on the curve; each file holds a
    stretch of it, whose bounds of ``tile_row`` and ``tile_col`` are in its statistics.
    """
    laid = curve_layout(tiles, partitions)
    laid.write.parquet(path)


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """An image (RASTER_ROWS or STACK) as a table bucketed and sorted on the line key.

    Images that are stored in as many buckets join on their line keys without an exchange
    (``assemble_stack``): what a join would shuffle every time is shuffled once, here.  One
    file per bucket.  ``path`` puts the files there instead of the warehouse.
    """
    writer = (
        rows.repartition(buckets, *LINE_KEY)
        .write.bucketBy(buckets, *LINE_KEY)
        .sortBy(*LINE_KEY)
        .format("parquet")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of :func:`write_bucketed`, with its layout."""
    return spark.table(table)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to the machine's own temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridfuse-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
