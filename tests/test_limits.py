"""What large values, nulls, ragged lines and wrong input do."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from gridfuse.functions import packing
from gridfuse.functions.window_fusion import register_fusion
from gridfuse.operators import kernel, neighborhood, regression
from gridfuse.plans.fuse import fuse
from gridfuse.schema import RASTER_ROWS, Grid
from gridfuse.sources import wide
from rasters import cells_of, image_of, noisy_image, raster_rows, stack_rows

ENGINES = ("arrow", "expr")
LAYOUTS = (Grid(tile_rows=4, tile_cols=3), Grid(tile_rows=64), Grid(tile_rows=5, tile_cols=None))
STRIPS = Grid(tile_rows=64, tile_cols=None)


@pytest.mark.parametrize("base", [10_000_000, 20_000_000, 100_000_000])
def test_large_values_in_both_engines_and_any_layout(spark, base):
    small = noisy_image(31, 9, 8, no_data=0)
    image = {k: tuple(x + base for x in v) for k, v in small.items()}
    lines = raster_rows(spark, {"a": image})
    wanted = {k: v + base for k, v in brute.fuse(small).items()}
    for engine in ENGINES:
        for grid in LAYOUTS:
            found = cells_of(fuse(lines, grid=grid, engine=engine))["a"]
            for cell, value in wanted.items():
                assert found[cell] == pytest.approx(value, abs=1e-6), (engine, grid, cell)


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("slope", ["coarse_on_fine", "fine_on_coarse"])
def test_values_over_the_whole_range_of_int(spark, engine, slope):
    rnd = random.Random(7)
    ends = [-(2**31), 2**31 - 1, -2_000_000_000, 2_000_000_000, -1, 1]
    mixed = image_of(7, 8, lambda r, c: [rnd.choice(ends) for _ in range(5)])
    spread = image_of(6, 9, lambda r, c: [rnd.randint(-(2**31), 2**31 - 1) for _ in range(5)])
    for image in (mixed, spread):
        wanted = brute.fuse(image, num_class=1, slope=slope)
        lines = raster_rows(spark, {"a": image})
        for grid in LAYOUTS[:2]:
            fused = fuse(lines, num_class=1, slope=slope, engine=engine, grid=grid)
            found = cells_of(fused)["a"]
            for cell, value in wanted.items():
                assert found[cell] == pytest.approx(value, rel=1e-9, abs=1), (cell, grid)


def test_exact_slopes_are_the_usual_ones_for_small_values():
    rng = np.random.default_rng(5)
    grids = {b: rng.integers(0, 60, size=(12, 14)).astype(np.int32) for b in brute.BANDS}
    for slope in ("coarse_on_fine", "fine_on_coarse"):
        _, _, _, sx, sy, sxy, sxx, _, similar = (
            v.astype(np.int64) for v in kernel._similar_sums(grids, 20, 25, 5, slope, 8, 10)
        )
        usual = kernel._slopes(2 * similar, sx, sy, sxy, sxx)
        assert np.array_equal(usual, kernel._exact_slopes(grids, 20, 25, 5, slope, 8, 10))


@pytest.mark.parametrize("engine", ENGINES)
def test_null_cells_are_no_data(spark, engine):
    image = noisy_image(32, 5, 6, no_data=0)
    image[2, 3] = (0, 0, 0, 0, 0)
    lines = raster_rows(spark, {"a": image})
    holed = F.expr(
        "if(row_key = 2, transform(pixels, (x, i) -> if(i = 3, cast(null as int), x)), pixels)"
    )
    found = cells_of(fuse(lines.withColumn("pixels", holed), grid=LAYOUTS[0], engine=engine))["a"]
    for cell, value in brute.fuse(image).items():
        assert found[cell] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("column, text", [("row_key", "no key"), ("pixels", "no cells")])
def test_null_keys_and_lines_are_errors(spark, engine, column, text):
    lines = raster_rows(spark, {"a": noisy_image(33, 3, 4)})
    gone = F.when(F.col("row_key") != 1, F.col(column))
    with pytest.raises(Exception, match=text):
        fuse(lines.withColumn(column, gone), engine=engine).collect()


def test_wide_table_with_a_missing_line_number(spark):
    table = spark.createDataFrame([(1.0, 0), (2.0, None)], "`0` double, line int")
    with pytest.raises(Exception, match="no line number"):
        wide.rows_from_wide(table, "fine1").collect()


def test_longer_line_than_the_wide_table(spark):
    rows = spark.createDataFrame([("s0", "fine1", 0, [1, 2, 3, 4, 5])], RASTER_ROWS)
    assert wide.wide_from_rows(rows, 5).first()["4"] == 5.0
    with pytest.raises(Exception, match="more than 3 cells"):
        wide.wide_from_rows(rows, 3).collect()


def test_packing_keeps_null_lines(spark):
    rows = spark.createDataFrame([(0, [1, None, 3]), (1, None), (2, [])], "k int, px array<int>")
    back = rows.select("k", packing.pack_cells("px").alias("b"))
    assert back.where("b is null").count() == 1
    cells = {r.k: r.px for r in back.select("k", packing.unpack_cells("b").alias("px")).collect()}
    assert cells == {0: [1, 0, 3], 1: None, 2: []}


@pytest.mark.parametrize("number", [0, 7, -1, -(2**31), 2**31 - 1])
def test_number_of_a_packed_line(spark, number):
    row = spark.createDataFrame([([5, 6], number)], "px array<int>, k int")
    packed = row.select(packing.pack_line("px", "k").alias("b"))
    assert packed.select(packing.packed_line_number("b")).first()[0] == number


def test_block_sums_of_ragged_lines(spark):
    lengths = [3, 5, 2, 7, 7, 1, 4, 6]
    image = {
        (r, c): tuple(10 * r + c + k for k in range(5)) for r, n in enumerate(lengths) for c in range(n)
    }
    grid = Grid(tile_rows=3, tile_cols=4)
    tiles = neighborhood.tile_stack(stack_rows(spark, {"a": image}), grid)
    sums = neighborhood.window_sums(tiles, grid)
    found = {(r.row_key, r.col): (r.tp, r.tkm, r.tkn) for r in sums.collect()}
    wanted = {}
    for r, c in image:
        near = [v for _, _, v in brute.block(image, r, c, 5)]
        wanted[r, c] = tuple(sum(v[k] for v in near) for k in (4, 2, 3))
    assert found == wanted


def by_sql(spark, stack, frame=4):
    register_fusion(spark, "checked_fuse")
    tiles = neighborhood.tile_stack_with_limits(stack, grid=STRIPS)
    return spark.sql(
        f"""SELECT row_key, checked_fuse(row_key, fine1, fine2, coarse1, coarse2, coarse0, t1, t2)
              OVER (PARTITION BY scene, tile_row, tile_col ORDER BY row_key
                    RANGE BETWEEN CURRENT ROW AND {frame} FOLLOWING) AS pixels FROM {{tiles}}""",
        tiles=tiles,
    )


def test_sql_fusion_checks_its_input(spark):
    stack = stack_rows(spark, {"a": noisy_image(34, 6, 5)})
    assert by_sql(spark, stack).count() == 6
    with pytest.raises(Exception, match="occurs more than once"):
        by_sql(spark, stack.union(stack.where("row_key = 2"))).collect()
    cut = stack.withColumn("fine2", F.expr("if(row_key = 3, slice(fine2, 1, 2), fine2)"))
    with pytest.raises(Exception, match="differ in length"):
        by_sql(spark, cut).collect()
    with pytest.raises(Exception, match="5 lines at most"):
        by_sql(spark, stack, frame=5).collect()


def test_regression_of_a_whole_table_and_of_a_null_group(spark):
    points = spark.createDataFrame(
        [(None, 0.0, 1.0), (None, 2.0, 5.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 3.0)],
        "g string, x double, y double",
    )
    fit = regression.regression_fit(points, "x", "y", ["g"])
    rows = regression.regression_eval(points, fit, "x", ["g"]).collect()
    assert sorted((r.x, r.yhat) for r in rows if r.g is None) == [(0.0, 1.0), (2.0, 5.0)]
    assert all(r.yhat is None for r in rows if r.g is not None)
    whole = regression.regression_eval(points, regression.regression_fit(points, "x", "y"), "x")
    assert whole.count() == 5 and whole.where("yhat is null").count() == 0
