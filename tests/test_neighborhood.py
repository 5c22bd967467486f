import pytest
from pyspark.sql import functions as F

import brute
from gridfuse.operators import neighborhood, predict, similarity
from gridfuse.operators.layout import stack_to_lines
from gridfuse.schema import Grid
from rasters import image_of, lines_of, noisy_image, stack_rows

GRIDS = (Grid(tile_rows=3, tile_cols=4), Grid(tile_rows=100, tile_cols=None))


def gapped(seed):
    return {k: v for k, v in noisy_image(seed, 11, 9).items() if k[0] not in (4, 7, 8)}


@pytest.mark.parametrize("grid", GRIDS, ids=str)
def test_neighbors(spark, grid):
    image = gapped(1)
    tiles = neighborhood.tile_stack(stack_rows(spark, {"a": image}), grid)
    for centre in (False, True):
        rows = neighborhood.neighbors(tiles, grid, centre).collect()
        found = {
            (r["row_key"], r["col"], r["dr"], r["dc"]): (
                tuple(r[b] for b in brute.BANDS),
                tuple(r["near_" + b] for b in brute.BANDS),
            )
            for r in rows
        }
        assert len(found) == len(rows)
        wanted = {
            (r, c, dr, dc): (cell, near)
            for (r, c), cell in image.items()
            for dr, dc, near in brute.block(image, r, c, 5)
            if centre or dr or dc
        }
        assert found == wanted


@pytest.mark.parametrize("grid", GRIDS, ids=str)
def test_window_sums(spark, grid):
    image = gapped(2)
    tiles = neighborhood.tile_stack(stack_rows(spark, {"a": image}), grid)
    found = {
        (r["row_key"], r["col"]): (r["tp"], r["tkm"], r["tkn"])
        for r in neighborhood.window_sums(tiles, grid).collect()
    }
    wanted = {
        cell: tuple(sum(v[k] for _, _, v in brute.block(image, *cell, 5)) for k in (4, 2, 3))
        for cell in image
    }
    assert found == wanted


def test_window_rows(spark):
    image = gapped(3)
    keys = sorted({r for r, _ in image})
    grid = Grid(tile_rows=2)
    rows = neighborhood.window_rows(stack_rows(spark, {"a": image, "b": image}), grid).collect()
    assert len(rows) == 2 * len(keys)
    for row in rows:
        wanted = [k for k in keys if row["row_key"] <= k <= row["row_key"] + 4]
        assert row["keys"] == wanted
        assert (row["n_lines"], row["base_key"]) == (len(wanted), row["row_key"])


def test_line_at(spark):
    image = gapped(4)
    grid = Grid(tile_rows=3, tile_cols=None)
    tiles = neighborhood.tile_stack(stack_rows(spark, {"a": image}), grid)
    lines = lines_of(image)
    found = {
        r["row_key"]: r["pixels"] for r in neighborhood.line_at(tiles, 2, "fine2", grid).collect()
    }
    assert found == {
        k: [cell[1] for cell in lines[k + 2]] for k in lines if k + 2 in lines
    }


def test_similar_cells_and_weights(spark):
    image = noisy_image(5, 8, 9, no_data=0.15)
    grid = GRIDS[0]
    tiles = neighborhood.tile_stack_with_limits(stack_rows(spark, {"a": image}), grid=grid)
    found = similarity.similar_pixels(neighborhood.neighbors(tiles, grid))
    rows = similarity.weights(similarity.spectral_corr(found), grid).collect()
    t1, t2 = brute.thresholds(image)
    wanted = {}
    for r, c in image:
        near = brute.similar(image, r, c, t1, t2, 5)
        raw = [brute.raw_weight(dr, dc, v, 5) for dr, dc, v in near]
        for (dr, dc, v), w in zip(near, raw):
            wanted[r, c, dr, dc] = (brute.correlation(v), w / sum(raw))
    assert len(rows) == len(wanted)
    total = {}
    for row in rows:
        corr, weight = wanted[row["row_key"], row["col"], row["dr"], row["dc"]]
        assert row["r"] == pytest.approx(corr)
        assert row["w"] == pytest.approx(weight, rel=1e-6)
        cell = row["row_key"], row["col"]
        total[cell] = total.get(cell, 0) + row["w"]
    assert all(w == pytest.approx(1) for w in total.values())


def test_slope_of_every_cell(spark):
    image = noisy_image(6, 7, 7, no_data=0.3)
    grid = GRIDS[0]
    tiles = neighborhood.tile_stack_with_limits(stack_rows(spark, {"a": image}), grid=grid)
    near = neighborhood.neighbors(tiles, grid, centre=True)
    t1, t2 = brute.thresholds(image)
    for orientation in predict.SLOPES:
        sums = predict.pixel_sums(near, orientation, grid)
        rows = predict.conversion_slope(sums).collect()
        assert len(rows) == len(image)
        for row in rows:
            found = brute.similar(image, row["row_key"], row["col"], t1, t2, 5)
            assert row["n_similar"] == len(found)
            assert row["v"] == pytest.approx(brute.slope_of(found, orientation))


@pytest.mark.parametrize("zero_change", ("limit", "zero"))
def test_date_weights(spark, zero_change):
    sums = [(10, 4, 13), (10, 10, 13), (10, 4, 10), (10, 10, 10), (0, -5, 5)]
    frame = spark.createDataFrame(sums, "tp bigint, tkm bigint, tkn bigint")
    for row in predict.temporal_weights(frame, zero_change).collect():
        wanted = brute.date_weights(row["tp"], row["tkm"], row["tkn"], zero_change)
        assert (row["tm"], row["tn"]) == pytest.approx(wanted)
        assert zero_change == "zero" or row["tm"] + row["tn"] == pytest.approx(1)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_scene_is_not_one_task(spark):
    """No window over a single partition, no nested loop, one exchange for the tiles."""
    grid = GRIDS[0]
    tiles = neighborhood.tile_stack(stack_rows(spark, {"a": noisy_image(7, 6, 6)}), grid)
    for frame in (
        neighborhood.window_sums(tiles, grid),
        neighborhood.neighbors(tiles, grid),
        neighborhood.window_rows(stack_rows(spark, {"a": noisy_image(7, 6, 6)}), grid),
    ):
        plan = _plan(frame)
        assert plan.count("Exchange") == 1
        assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_sums_add_no_exchange(spark):
    grid = GRIDS[0]
    stack = stack_rows(spark, {"a": image_of(4, 4, lambda r, c: (1, 2, 3, 4, 5))})
    tiles = neighborhood.tile_stack_with_limits(stack, grid=grid)
    near = neighborhood.neighbors(tiles, grid, centre=True)
    plan = _plan(predict.fused_pixels(predict.pixel_sums(near, grid=grid)))
    assert plan.count("Exchange") == _plan(tiles).count("Exchange")


def test_lines_of_a_stack(spark):
    image = noisy_image(8, 4, 5)
    lines = stack_to_lines(stack_rows(spark, {"a": image}))
    assert lines.count() == 20
    total = lines.select(F.explode("pixels").alias("x")).agg(F.sum("x")).first()[0]
    assert total == sum(sum(cell) for cell in image.values())


def sums_by_cell(rows):
    return {(r["scene"], r["row_key"], r["col"]): (r["tp"], r["tkm"], r["tkn"]) for r in rows.collect()}


@pytest.mark.parametrize("window", (3, 5, 9))
@pytest.mark.parametrize("cols", (4, None))
def test_block_sums_from_summed_areas(spark, window, cols):
    """Gaps, ragged lines, tile edges: the same sums as by whole tiles, without Python."""
    ragged = {(r, c): v for (r, c), v in gapped(12).items() if c < 9 - (3 * r) % 7}
    for tile_rows in (3, 64):
        grid = Grid(window, tile_rows, cols)
        tiles = neighborhood.tile_stack(stack_rows(spark, {"a": gapped(11), "b": ragged}), grid)
        found = neighborhood.block_sums(tiles, grid)
        assert sums_by_cell(found) == sums_by_cell(neighborhood.window_sums(tiles, grid))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert "ENSURE_REQUIREMENTS" not in plan  # only the tiles are dealt out


def test_block_sums_cost_the_same_for_any_window(spark):
    """The plans differ in the distances of the look-ups only."""
    plans = set()
    for window in (3, 9):
        grid = Grid(window, 8, 4)
        tiles = neighborhood.tile_stack(stack_rows(spark, {"a": gapped(13)}), grid)
        plan = neighborhood.block_sums(tiles, grid)._jdf.queryExecution().executedPlan().toString()
        plans.add(tuple(plan.count(node) for node in ("Window", "Sort", "Generate", "Exchange")))
    assert len(plans) == 1
