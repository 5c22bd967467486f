"""Table layouts and settings shared by every module.

RASTER_ROWS  one row per raster line and band
STACK        one row per raster line, the five bands side by side
FUSED        one row per line of the fused image
"""

from dataclasses import dataclass

from pyspark.sql import types as T

# The five images of one fusion, fine and coarse at the two
# known dates and coarse at the wanted date.
BANDS = ("fine1", "fine2", "coarse1", "coarse2", "coarse0")

NUM_CLASS = 4

LINE_KEY = ["scene", "row_key"]
TILE_KEY = ["scene", "tile_row", "tile_col"]
PIXEL_KEY = [*TILE_KEY, "row_key", "col"]

_LINE = T.ArrayType(T.IntegerType(), False)

RASTER_ROWS = T.StructType(
    [
        T.StructField("scene", T.StringType()),
        T.StructField("band", T.StringType()),
        T.StructField("row_key", T.IntegerType()),
        T.StructField("pixels", _LINE),
    ]
)

STACK = T.StructType(
    [T.StructField("scene", T.StringType()), T.StructField("row_key", T.IntegerType())]
    + [T.StructField(b, _LINE) for b in BANDS]
)

FUSED = T.StructType(
    [
        T.StructField("scene", T.StringType()),
        T.StructField("row_key", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.FloatType(), False)),
    ]
)


@dataclass(frozen=True)
class Grid:
    """How an image is cut into tiles for the sliding neighbourhood.

    A cell looks at ``window`` lines and columns, itself first.  A tile owns
    ``tile_rows`` by ``tile_cols`` cells; ``tile_cols=None`` leaves lines
    uncut, which suits images of a known moderate width.  ``partitions`` is the
    number of shuffle partitions, by default ``spark.sql.shuffle.partitions``.
    """

    window: int = 5
    tile_rows: int = 256
    tile_cols: int | None = 1024
    partitions: int | None = None

    def __post_init__(self):
        if self.window < 2:
            raise ValueError("a neighbourhood needs a window of at least 2")
        if self.tile_rows < 1 or (self.tile_cols is not None and self.tile_cols < 1):
            raise ValueError("a tile needs at least one line and one column")

    @property
    def halo(self) -> int:
        return self.window - 1
