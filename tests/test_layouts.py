"""Stored sums, tiles along a curve, the grouped aggregate, very wide files."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridfuse.functions.window_fusion import register_tile_fusion
from gridfuse.operators import layout, neighborhood, stats
from gridfuse.plans.fuse import fuse, join_parts
from gridfuse.schema import BANDS, Grid
from gridfuse.sources import store, wide
from rasters import cells_of, noisy_image, raster_rows, stack_rows

GRID = Grid(tile_rows=8, tile_cols=5)


def thresholds(limits):
    return {r["scene"]: (r["t1"], r["t2"]) for r in limits.collect()}


def test_thresholds_from_stored_sums(spark, tmp_path):
    """Bit by bit the same, also from sums of parts that were written one after the other."""
    images = {"a": noisy_image(1, 37, 9), "b": noisy_image(2, 9, 12)}
    rows = raster_rows(spark, images)
    path = str(tmp_path / "sums")
    for part in (F.col("row_key") % 3 == 0, F.col("row_key") % 3 != 0):
        store.write_moments(rows.where(part), path, GRID)
    moments = store.read_moments(spark, path)
    assert thresholds(stats.limits_from(moments)) == thresholds(stats.similarity_threshold(rows))
    lines = str(tmp_path / "lines")
    store.write_lines(rows, lines)
    stored = spark.read.parquet(lines)
    plain, summed = fuse(stored, grid=GRID), fuse(stored, grid=GRID, moments=moments)
    assert cells_of(summed) == cells_of(plain)

    def scans_of_cells(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum("ReadSchema" in line and "pixels" in line for line in plan.splitlines())

    assert scans_of_cells(summed) < scans_of_cells(plain)


def test_the_curve_interleaves_bits(spark):
    places = [(0, 0), (0, 1), (1, 0), (1, 1), (5, 9), (1000, 3), (-2, -1), (2**20, 2**19 + 5)]
    rows = spark.createDataFrame(places, "tile_row int, tile_col int")
    found = {(r[0], r[1]): r[2] for r in rows.select("*", layout.curve_key()).collect()}

    def mixed(row, col):
        row, col = row + 2**30, col + 2**30
        return sum(((row >> k & 1) << 2 * k + 1) | ((col >> k & 1) << 2 * k) for k in range(31))

    assert found == {place: mixed(*place) for place in places}


def test_a_box_reads_few_files(spark, tmp_path):
    grid = Grid(tile_rows=4, tile_cols=4)
    image = noisy_image(3, 64, 64)
    tiles = layout.cut_tiles(stack_rows(spark, {"a": image}), BANDS, grid)
    path = str(tmp_path / "tiles")
    store.write_tiles(tiles, path, 16)
    stored = spark.read.parquet(path)
    held = stored.where(layout.in_box(8, 15, 8, 15, grid))
    assert "PushedFilters" in held._jdf.queryExecution().executedPlan().toString()
    tested = 0
    for file in stored.inputFiles():
        found = pq.ParquetFile(file.removeprefix("file://")).metadata
        names = [found.schema.column(k).name for k in range(found.num_columns)]
        bounds = {}
        for name in ("tile_row", "tile_col"):
            parts = [found.row_group(g).column(names.index(name)).statistics for g in range(found.num_row_groups)]
            bounds[name] = (min(p.min for p in parts), max(p.max for p in parts))
        tested += all(low <= 3 and high >= 2 for low, high in bounds.values())
    assert tested <= 3 < len(stored.inputFiles())
    keys = {(r["tile_row"], r["tile_col"]) for r in held.collect()}
    assert keys == {(2, 2), (2, 3), (3, 2), (3, 3)}


def by_group(spark, tiles, grid):
    register_tile_fusion(spark, "tested_fuse", grid=grid)
    return join_parts(
        spark.sql(
            """SELECT scene, tile_col, inline(lines) FROM (
                 SELECT scene, tile_row, tile_col, tested_fuse(tile_row, row_key, fine1, fine2,
                   coarse1, coarse2, coarse0, t1, t2) AS lines
                 FROM {tiles} GROUP BY scene, tile_row, tile_col)""",
            tiles=tiles,
        )
    )


@pytest.mark.parametrize("grid", (GRID, Grid(tile_rows=6, tile_cols=None)), ids=str)
def test_grouped_fusion(spark, grid):
    image = {k: v for k, v in noisy_image(4, 21, 11).items() if k[0] not in (5, 6, 13)}
    stack = stack_rows(spark, {"a": image, "b": noisy_image(5, 7, 4)})
    tiles = neighborhood.tile_stack_with_limits(stack, grid=grid)
    assert cells_of(by_group(spark, tiles, grid)) == cells_of(fuse(stack, grid=grid))


def test_grouped_fusion_checks_its_input(spark):
    stack = stack_rows(spark, {"a": noisy_image(6, 6, 6)})
    tiles = neighborhood.tile_stack_with_limits(stack, grid=GRID)
    with pytest.raises(Exception, match="no similarity threshold"):
        by_group(spark, tiles.withColumn("t1", F.lit(None).cast("double")), GRID).collect()
    with pytest.raises(Exception, match="more than once"):
        by_group(spark, tiles.unionByName(tiles), GRID).collect()


def test_very_wide_files(spark, tmp_path, monkeypatch):
    """Three thousand columns, odd cells, blocks smaller than a line and a batch."""
    monkeypatch.setattr(wide, "LINES_AT_ONCE", 3)
    rng = np.random.default_rng(7)
    cells = rng.uniform(-3e9, 3e9, size=(8, 3000))
    cells[0, :9] = [np.nan, np.inf, -np.inf, 2.0**31, -(2.0**31), 2.0**31 - 1, -0.9, 1.9, 0]
    columns = {str(c): pa.array(cells[:, c]) for c in range(3000)}
    columns["7"] = pa.array([None] * 8, pa.float64())
    columns["3000"] = pa.array(np.arange(8.0))
    path = str(tmp_path / "wide.parquet")
    pq.write_table(pa.table({**columns, "__index_level_0__": pa.array(range(8))}), path)
    table = spark.read.parquet(path)
    found = wide.transposed_rows(table, "fine1", "x")
    few = [*map(str, range(40)), "3000", "__index_level_0__"]
    wanted = {r["row_key"]: r["pixels"] for r in wide.rows_from_wide(table.select(*few), "fine1").collect()}
    rows = {r["row_key"]: r["pixels"] for r in found.collect()}
    assert {k: v[:40] for k, v in rows.items()} == wanted
    inside = np.abs(np.trunc(cells)) < 2**31
    exact = np.where(inside, np.trunc(np.where(inside, cells, 0)), 0)
    exact[0, 4], exact[:, 7] = -(2**31), 0
    assert all(rows[r] == exact[r].astype(int).tolist() for r in range(8))
    with pytest.raises(Exception, match="no line number"):
        holed = table.withColumn("__index_level_0__", F.lit(None).cast("bigint"))
        wide.transposed_rows(holed, "fine1").collect()
