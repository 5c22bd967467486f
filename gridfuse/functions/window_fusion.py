"""The fusion as a SQL aggregate over a window of lines.

    SELECT row_key, fuse_line(row_key, fine1, fine2, coarse1, coarse2, coarse0, t1, t2)
      OVER (PARTITION BY scene, tile_row, tile_col ORDER BY row_key
            RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING)
    FROM strips

The frame holds the line and those below it; ``PARTITION BY`` keeps an image out
of a single task.  It runs once per line and takes up each line five times.  For whole
images there is the aggregate of a tile, which runs once per tile:

    SELECT scene, tile_col, inline(lines) FROM (
      SELECT scene, tile_row, tile_col,
             fuse_tile(tile_row, row_key, fine1, fine2, coarse1, coarse2, coarse0, t1, t2) AS lines
      FROM tiles GROUP BY scene, tile_row, tile_col)
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfuse.operators.kernel import fuse_grids, fuse_tile
from gridfuse.schema import BANDS, Grid


def fusion_function(
    window: int = 5, slope: str = "coarse_on_fine", zero_change: str = "limit"
):
    """The aggregate: line keys, five bands and two thresholds in, a fused line out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def fuse_line(
        row_key: pa.Array,
        fine1: pa.Array,
        fine2: pa.Array,
        coarse1: pa.Array,
        coarse2: pa.Array,
        coarse0: pa.Array,
        t1: pa.Array,
        t2: pa.Array,
    ) -> pa.Scalar:
        keys = row_key.to_numpy(zero_copy_only=False)
        top = keys.min()
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a line occurs more than once in a window")
        if keys.max() - top >= window:
            raise ValueError(f"the window's frame must hold {window} lines at most")
        lines = dict(zip(BANDS, (fine1, fine2, coarse1, coarse2, coarse0)))
        target = int(np.flatnonzero(keys == top)[0])
        width = len(fine1[target])
        for at in range(len(keys)):
            if len({len(values[at]) for values in lines.values()}) > 1:
                raise ValueError(f"the five bands differ in length on line {keys[at]}")
        grids = {b: np.zeros((window, width + window - 1), np.int32) for b in BANDS}
        for band, values in lines.items():
            for key, line in zip(keys, values):
                cells = line.values.fill_null(0).to_numpy(zero_copy_only=False)
                cells = cells[: width + window - 1]
                grids[band][key - top, : len(cells)] = cells
        limits = t1[target].as_py(), t2[target].as_py()
        if None in limits:
            raise ValueError("no similarity threshold for this line")
        fused = fuse_grids(grids, *limits, window, slope, zero_change)[0]
        return pa.scalar(fused.tolist(), pa.list_(pa.float64()))

    return fuse_line


FUSED_LINES = T.ArrayType(
    T.StructType(
        [
            T.StructField("row_key", T.IntegerType()),
            T.StructField("pixels", T.ArrayType(T.DoubleType())),
        ]
    )
)


def tile_fusion_function(
    grid: Grid = Grid(), slope: str = "coarse_on_fine", zero_change: str = "limit"
):
    """The aggregate of a whole tile, for ``GROUP BY``: its fused lines, ordered by key.

    One call per tile, each line taken up once, so columns may be cut as well as lines.
    """

    @F.arrow_udf(FUSED_LINES)
    def fuse_tile_lines(
        tile_row: pa.Array,
        row_key: pa.Array,
        fine1: pa.Array,
        fine2: pa.Array,
        coarse1: pa.Array,
        coarse2: pa.Array,
        coarse0: pa.Array,
        t1: pa.Array,
        t2: pa.Array,
    ) -> pa.Scalar:
        lines, n = dict(zip(BANDS, (fine1, fine2, coarse1, coarse2, coarse0))), len(row_key)
        table = pa.table(
            {
                "tile_row": pa.concat_arrays([tile_row] * len(BANDS)),
                "row_key": pa.concat_arrays([row_key] * len(BANDS)),
                "band": pa.array([band for band in BANDS for _ in range(n)]),
                "pixels": pa.concat_arrays([_filled(lines[band]) for band in BANDS]),
                "t1": pa.concat_arrays([t1] * len(BANDS)),
                "t2": pa.concat_arrays([t2] * len(BANDS)),
            }
        )
        keys, ends, values = fuse_tile(table, grid, slope, zero_change)
        fused = [
            {"row_key": int(key), "pixels": values[begin:end].tolist()}
            for key, begin, end in zip(keys, ends, ends[1:])
        ]
        kind = pa.list_(pa.struct([("row_key", pa.int32()), ("pixels", pa.list_(pa.float64()))]))
        return pa.scalar(fused, kind)

    return fuse_tile_lines


def _filled(lines: pa.Array) -> pa.Array:
    """Lines whose null cells are no-data, from the beginning of their buffers."""
    cells = lines.flatten().fill_null(0)
    lengths = np.diff(lines.offsets.to_numpy())
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), cells)


def register_tile_fusion(spark: SparkSession, name: str = "fuse_tile", **options):
    """Make the grouped aggregate known to SQL under a name."""
    return spark.udf.register(name, tile_fusion_function(**options))


def register_fusion(spark: SparkSession, name: str = "fuse_line", **options):
    """Make the aggregate known to SQL under a name."""
    return spark.udf.register(name, fusion_function(**options))
