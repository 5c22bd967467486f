"""The wide raster file: one row per line, one double column per raster column.

Column names are ``"0" .. "cols-1"``, then ``str(cols)`` with the line number as
a double, and as a rule ``__index_level_0__`` with the line number as the last
column.  Convert such a file once; everything else works on RASTER_ROWS.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.functions.pixels import to_digital_numbers
from gridfuse.operators.layout import stack_images
from gridfuse.schema import BANDS

# Fixed value: the name that a stored pandas index has in parquet.
INDEX_COLUMN = "__index_level_0__"

#: How much of a wide table is turned at a time.
COLUMNS_AT_ONCE, LINES_AT_ONCE = 512, 256

#: Up to so many files, one row of a few hundred bytes each, their starts go to all tasks.
BROADCAST_FILES = 20_000
_FILE = "__file__"


def rows_from_wide(
    wide: DataFrame, band: str, scene: str = "s0", key: str | None = None
) -> DataFrame:
    """Wide table to RASTER_ROWS; one projection.

    The key is the last column.  If that is a pandas index, the column before
    it repeats the line number and is no pixel.  With ``key`` given, all
    other columns are pixels.  Cells are truncated to int, and cells that are no
    number become no-data.
    """
    names = wide.columns
    if key is not None:
        pixels = [c for c in names if c != key]
    else:
        key = names[-1]
        pixels = names[:-2] if key == INDEX_COLUMN else names[:-1]
    missing = F.raise_error(F.lit("a line of a wide table has no line number")).cast("int")
    line = F.coalesce(F.col(f"`{key}`").cast("int"), missing)
    # Tied to the key rather than a bare constant: a constant would be folded out of the
    # join keys and with it the match between their partitioning and that of the tiles.
    of_scene = F.when(line.isNotNull(), F.lit(scene))
    # The line is one array before it is cast: thousands of column casts are slow to compile.
    cells = F.array(*[F.col(f"`{c}`") for c in pixels])
    return wide.select(of_scene.alias("scene"), line.alias("row_key"), cells.alias("line")).select(
        "scene",
        F.lit(band).alias("band"),
        "row_key",
        to_digital_numbers(F.col("line")).alias("pixels"),
    )


def transposed_rows(
    wide: DataFrame, band: str, scene: str = "s0", key: str | None = None
) -> DataFrame:
    """:func:`rows_from_wide` for files of very many columns, in Arrow batches.

    A plan with an expression per column grows with the width of the image; here columns are
    put together as arrays in blocks of ``COLUMNS_AT_ONCE``, by one function whatever the
    width.  Results are the same.
    """
    names = wide.columns
    line = key if key is not None else names[-1]
    pixels = [c for c in names if c != line]
    if key is None and line == INDEX_COLUMN:
        pixels = pixels[:-1]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Few lines at a time: a line of ten thousand columns is 80 kB.
            for first in range(0, whole.num_rows, LINES_AT_ONCE):
                batch = whole.slice(first, LINES_AT_ONCE)
                if batch.column(line).null_count:
                    raise ValueError("a line of a wide table has no line number")
                cells = np.zeros((batch.num_rows, len(pixels)), np.int32)
                for left in range(0, len(pixels), COLUMNS_AT_ONCE):
                    for c in range(left, min(left + COLUMNS_AT_ONCE, len(pixels))):
                        values = batch.column(pixels[c]).cast(pa.float64()).fill_null(0)
                        cells[:, c] = _digital_numbers(values.to_numpy(zero_copy_only=False))
                ends = np.arange(0, cells.size + 1, len(pixels) or 1, dtype=np.int32)
                if not pixels:
                    ends = np.zeros(batch.num_rows + 1, np.int32)
                numbers = np.trunc(batch.column(line).to_numpy(zero_copy_only=False)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([scene] * batch.num_rows),
                        pa.array([band] * batch.num_rows),
                        pa.array(numbers),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel())),
                    ],
                    names=["scene", "band", "row_key", "pixels"],
                )

    wanted = wide.select(*[f"`{c}`" for c in [*pixels, line]])
    return wanted.mapInArrow(over, "scene string, band string, row_key int, pixels array<int>")


def _digital_numbers(cells: np.ndarray) -> np.ndarray:
    """Truncated toward zero; what is no number or outside int is no-data."""
    whole = np.trunc(cells)
    with np.errstate(invalid="ignore"):
        inside = (whole >= -(2.0**31)) & (whole < 2.0**31)
    return np.where(inside, whole, 0).astype(np.int32)


def read_image(spark: SparkSession, path: str, band: str, scene: str = "s0") -> DataFrame:
    """A wide file that carries its line numbers, as RASTER_ROWS."""
    return rows_from_wide(spark.read.parquet(path), band, scene)


def _file_order(path) -> Column:
    """Paths in the order of their names, numbers in them by value."""
    parts = F.split(path, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    number = lambda part: F.lpad(part, 20, "0")
    return F.transform(parts, lambda part: F.when(part.rlike(r"^\d+$"), number(part)).otherwise(part))


def file_starts(wide: DataFrame) -> DataFrame:
    """(path, start) of every file with lines: how many lines the files before it have.

    Counts come from the files' footers; the running sum has one row per file.
    """
    counts = wide.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n")
    )
    before = Window.orderBy(_file_order(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def read_unnumbered_image(
    spark: SparkSession, path: str, band: str, scene: str = "s0"
) -> DataFrame:
    """A wide image of pixels only; the position in its files is the line number.

    Files follow each other in the order of their names (numbers by value, so that part 9
    comes before part 10), and lines in the order of the file.  The position in a file
    comes from the parquet reader, and what stands before the file from a running sum of
    row counts, so nothing is sorted and lines stay where they are read.
    """
    wide = spark.read.parquet(path)
    placed = wide.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.row_index").alias(INDEX_COLUMN),
    )
    starts = file_starts(wide).withColumnRenamed("path", _FILE)
    if len(wide.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    numbered = placed.join(starts, _FILE).withColumn(
        INDEX_COLUMN, F.col(INDEX_COLUMN) + F.col("start")
    )
    return rows_from_wide(numbered.drop(_FILE, "start"), band, scene, key=INDEX_COLUMN)


def read_images(
    spark: SparkSession,
    coarse0: str,
    fine1: str,
    fine2: str,
    coarse1: str,
    coarse2: str,
    scene: str = "s0",
) -> DataFrame:
    """Five wide files as the RASTER_ROWS table that a fusion takes."""
    paths = dict(coarse0=coarse0, fine1=fine1, fine2=fine2, coarse1=coarse1, coarse2=coarse2)
    return stack_images(**{b: read_image(spark, paths[b], b, scene) for b in BANDS})


def wide_from_rows(rows: DataFrame, cols: int) -> DataFrame:
    """Lines of one image as a wide table of ``cols`` columns, with its line numbers.

    Cells that a short line lacks are no-data; a longer line is an error.
    """
    too_long = F.raise_error(F.lit(f"a line has more than {cols} cells")).cast("array<double>")
    cells = F.concat(F.col("pixels").cast("array<double>"), F.array_repeat(F.lit(0.0), cols))
    cells = F.when(F.size("pixels") > cols, too_long).otherwise(cells)
    line = F.col("row_key")
    return rows.select(line, cells.alias("cells")).select(
        *[F.get("cells", F.lit(i)).alias(str(i)) for i in range(cols)],
        line.cast("double").alias(str(cols)),
        line.cast("bigint").alias(INDEX_COLUMN),
    )
