"""The first lines of a fused image, fused alone."""

import pytest
from pyspark.sql import functions as F

from gridfuse.plans.fuse import _within, fuse, fuse_preview, key_ranges, preview_keys
from gridfuse.schema import Grid
from rasters import noisy_image, raster_rows, stack_rows

GRID = Grid(tile_rows=8, tile_cols=5)


def lines_of(fused):
    return [(r["scene"], r["row_key"], r["pixels"]) for r in fused.collect()]


def first_lines(images, lines, **options):
    return lines_of(fuse(images, **options).orderBy("scene", "row_key").limit(lines))


@pytest.mark.parametrize("engine", ("arrow", "expr"))
@pytest.mark.parametrize("lines", (1, 20, 500))
def test_preview_is_the_start_of_the_whole(spark, engine, lines):
    images = {"a": noisy_image(1, 13, 9), "b": noisy_image(2, 40, 7), "c": noisy_image(3, 5, 6)}
    for table in (stack_rows(spark, images), raster_rows(spark, images, shuffle=4)):
        found = lines_of(fuse_preview(table, lines, grid=GRID, engine=engine))
        assert found == first_lines(table, lines, grid=GRID, engine=engine)


def test_preview_over_gaps_and_lines_that_a_band_lacks(spark):
    image = {k: v for k, v in noisy_image(4, 60, 6).items() if k[0] not in (3, 4, 5, 6, 7, 8, 15, 30)}
    rows = raster_rows(spark, {"a": image})
    lacking = rows.where("not (band = 'coarse0' and row_key in (1, 12))")
    for grid in (GRID, Grid(tile_rows=16, tile_cols=None)):
        found = lines_of(fuse_preview(lacking, 20, grid=grid))
        assert found == first_lines(lacking, 20, grid=grid)
        assert [key for _, key, _ in found][:3] == [0, 2, 9]


def test_preview_reads_its_windows_only(spark, tmp_path):
    rows = raster_rows(spark, {"a": noisy_image(5, 200, 4), "b": noisy_image(6, 50, 4)})
    path = str(tmp_path / "rows")
    rows.repartitionByRange(10, "scene", "row_key").sortWithinPartitions("row_key").write.parquet(path)
    stored = spark.read.parquet(path)
    ranges = key_ranges(preview_keys(stored, 20), GRID.halo)
    assert ranges == [("a", 0, 23)]
    held = stored.where(_within(ranges))
    assert held.count() == 24 * 5
    plan = held._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(row_key,0)" in pushed and "LessThanOrEqual(row_k" in pushed
    fused = fuse_preview(stored, 20, grid=GRID)
    assert "<= 23)" in fused._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_merged():
    keys = [("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 9), ("b", 30)]
    assert key_ranges(keys, 4) == [("a", 0, 13), ("b", 9, 13), ("b", 30, 34)]
    assert key_ranges([("a", 0), ("a", 6)], 4) == [("a", 0, 4), ("a", 6, 10)]


def test_no_lines(spark):
    empty = stack_rows(spark, {"a": noisy_image(7, 3, 3)}).limit(0)
    assert fuse_preview(empty, grid=GRID).count() == 0


def test_a_line_without_a_key_is_an_error(spark):
    images = raster_rows(spark, {"a": noisy_image(8, 4, 4)})
    images = images.withColumn("row_key", F.when(F.col("row_key") != 2, F.col("row_key")))
    with pytest.raises(ValueError, match="no key"):
        fuse_preview(images, grid=GRID)
