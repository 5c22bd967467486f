"""Every registered query against its SQL, on the given tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as app
import check_oracle
from catalog.queries import QUERIES
from catalog.sql import ORACLE
from gridfuse.operators.layout import stack_to_lines
from gridfuse.plans.fuse import fuse
from gridfuse.schema import Grid
from gridfuse.sources.order_raster import raster_cells, raster_stack

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    return check_oracle.open_tables(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(app.oracle_sql()) <= set(app.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    query, sql = QUERIES[name], ORACLE[name]
    assert check_oracle.compare(spark, tables, name, query, sql, SF_DIR) is None


def test_every_order_is_a_cell(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    lines = raster_stack(spark, SF_DIR)
    assert lines.agg(F.sum(F.size("fine1"))).first()[0] == orders


def test_fusion_beats_the_simple_guesses(spark):
    """Root mean square error against the image that the fusion has not seen."""
    stack = raster_stack(spark, SF_DIR)
    grid = Grid(tile_cols=None)
    fused = fuse(stack_to_lines(stack), grid=grid).select(
        "scene", "row_key", F.posexplode("pixels").alias("col", "fused")
    )
    cells = raster_cells(spark, SF_DIR).where("fine1 <> 0")
    joined = cells.join(fused, ["scene", "row_key", "col"])

    def rmse(guess):
        return F.sqrt(F.avg(F.pow(guess - F.col("truth"), 2)))

    errors = joined.agg(
        rmse(F.col("fused")), rmse(F.col("fine1")), rmse((F.col("fine1") + F.col("fine2")) / 2)
    ).first()
    assert errors[0] < 0.7 * errors[2] < errors[1]
