"""What several operators need: tables written on the way, and text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridfuse.sources.store import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Workspace:
    """Tables of one run in a new folder below ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs at most the tasks
    since the last table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that are worked on at a time.
SLICE = 1 << 22


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes, so that what a task makes of its rows does
    not grow with Spark's batches."""
    step = max(1, batch.num_rows * limit // max(batch.nbytes, limit))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def map_rows(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    sliced: bool = False,
):
    """``rows`` over the Arrow batches of df, or over slices; None where one gives no row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole) if sliced else (whole,):
                out = rows(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(over, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as Python strings, a null text as an empty one."""
    return [text or "" for text in batch.column(column).to_pylist()]
