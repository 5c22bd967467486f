"""A set of 64-bit hashes as a bit set of a fixed size, for the driver and all tasks.

It may say yes for a hash that is not in the set, never no for one that is: it saves
rows before an exchange, and a join decides afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.common import map_rows

BITS = 1 << 23


def bit_set(df: DataFrame, column: str) -> np.ndarray:
    """The values of a long column; at most BITS / 64 rows reach the driver."""
    rows = (
        df.where(F.col(column).isNotNull())
        .select(F.pmod(F.col(column), F.lit(BITS)).alias("bit"))
        .groupBy(F.expr("bit div 64").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
        .toPandas()
    )
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_set(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def some_rows(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows of docs whose ``doc_id`` may be in a set of ids; none with a null id."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        keep = in_set(ids.view(np.uint64), bits) & batch.column("doc_id").is_valid().to_numpy(
            zero_copy_only=False
        )
        return batch.filter(pa.array(keep))

    return map_rows(docs, rows, docs.schema)
