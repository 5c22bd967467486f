"""The packed binary forms of a line.

Packed cells are big-endian int32, a packed result is big-endian float32.  A
packed input line of other programs ends with the line number as one more
cell.  Whole Arrow batches are converted at once.

Tables whose ``pixels`` are packed move through a shuffle and into Python tasks as blocks
of bytes rather than cell by cell; store images that way if they are fused often.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The cell formats of packed lines.
INT_CELL, FLOAT_CELL = ">i4", ">f4"
CELL_BYTES = 4


def to_blobs(lines: pa.Array, dtype: str) -> pa.Array:
    """A null line is a null blob; a null cell is no-data."""
    known = lines.is_valid()
    lines = lines.fill_null([]) if lines.null_count else lines
    offsets = lines.offsets.to_numpy()
    cells = lines.values.fill_null(0).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    ends = (offsets - offsets[0]).astype(np.int64) * CELL_BYTES
    data = np.ascontiguousarray(cells.astype(dtype))
    blobs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lines), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )
    blobs = blobs.cast(pa.binary())
    return pa.compute.if_else(known, blobs, pa.scalar(None, pa.binary()))


def blob_cells(blobs: pa.Array, dtype: str):
    """The cells of all blobs of an array in one go, and where each blob begins and ends."""
    blobs = blobs.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[
        blobs.offset : blobs.offset + len(blobs) + 1
    ]
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype), (offsets - offsets[0]) // CELL_BYTES


def _from_blobs(blobs: pa.Array, dtype: str, native) -> pa.Array:
    cells, ends = blob_cells(blobs.fill_null(b""), dtype)
    known = blobs.is_null().to_numpy(zero_copy_only=False)
    ends = pa.array(ends, pa.int32(), mask=np.append(known, False))
    return pa.ListArray.from_arrays(ends, pa.array(cells.astype(native)))


@F.arrow_udf(T.BinaryType())
def _int_blob(lines: pa.Array) -> pa.Array:
    return to_blobs(lines, INT_CELL)


@F.arrow_udf(T.BinaryType())
def _float_blob(lines: pa.Array) -> pa.Array:
    return to_blobs(lines, FLOAT_CELL)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _int_cells(blobs: pa.Array) -> pa.Array:
    return _from_blobs(blobs, INT_CELL, np.int32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _float_cells(blobs: pa.Array) -> pa.Array:
    return _from_blobs(blobs, FLOAT_CELL, np.float32)


def is_packed(df: DataFrame, column: str = "pixels") -> bool:
    return dict(df.dtypes)[column] == "binary"


def pack_cells(pixels) -> Column:
    """The cells of a line as one blob."""
    return _int_blob(F.col(pixels))


def unpack_cells(blob) -> Column:
    return _int_cells(F.col(blob))


def pack_rows(rows: DataFrame) -> DataFrame:
    """RASTER_ROWS with packed pixels."""
    return rows.withColumn("pixels", pack_cells("pixels"))


def unpack_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pixels", unpack_cells("pixels"))


def pack_line(pixels, row_key) -> Column:
    """Cells and line number as one big-endian int32 blob."""
    return _int_blob(F.concat(F.col(pixels), F.array(F.col(row_key).cast("int"))))


def packed_line_number(blob) -> Column:
    """The line number at the end of a packed line."""
    last = F.conv(F.hex(F.substring(blob, -CELL_BYTES, CELL_BYTES)), 16, 10).cast("bigint")
    return F.when(last >= 2**31, last - 2**32).otherwise(last).cast("int")


def unpack_line(blob) -> Column:
    """The cells of a packed line, without its line number."""
    cells = _int_cells(F.col(blob))
    return F.slice(cells, F.lit(1), F.size(cells) - 1)


def pack_fused(pixels) -> Column:
    """A fused line as a big-endian float32 blob."""
    return _float_blob(F.col(pixels).cast("array<float>"))


def unpack_fused(blob) -> Column:
    return _float_cells(F.col(blob))
