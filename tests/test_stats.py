import statistics

import pytest

from gridfuse.functions.packing import pack_rows
from gridfuse.operators import layout, regression, stats
from gridfuse.schema import BANDS, Grid
from rasters import image_of, noisy_image, raster_rows, stack_rows


def test_image_statistics(spark):
    images = {"a": noisy_image(1, 9, 7), "b": noisy_image(2, 4, 12)}
    rows = raster_rows(spark, images)
    means = {(r["scene"], r["band"]): r["mean"] for r in stats.image_mean(rows).collect()}
    spreads = {
        (r["scene"], r["band"]): r["stddev"]
        for r in stats.image_stddev(rows, Grid(tile_rows=2)).collect()
    }
    shapes = {(r["scene"], r["band"]): r for r in stats.raster_shape(rows).collect()}
    for scene, image in images.items():
        for k, band in enumerate(BANDS):
            values = [cell[k] for cell in image.values()]
            assert means[scene, band] == pytest.approx(statistics.fmean(values))
            assert spreads[scene, band] == pytest.approx(statistics.pstdev(values))
            shape = shapes[scene, band]
            assert shape["n_dims"] == 2
            assert shape["n_cells"] == len(values) == shape["n_rows"] * shape["n_cols"]


def test_thresholds_do_not_depend_on_the_layout(spark):
    image = noisy_image(3, 30, 5)
    found = set()
    for seed in range(3):
        rows = raster_rows(spark, {"a": image}, shuffle=seed).repartition(seed + 1)
        found.add(stats.similarity_threshold(rows, 3, Grid(tile_rows=seed + 1)).first()[1:])
    assert len(found) == 1
    t1 = statistics.pstdev([cell[0] for cell in image.values()]) * 2 / 3
    assert found.pop()[0] == pytest.approx(t1, abs=1e-6)


def test_constant_image_has_no_spread(spark):
    rows = raster_rows(spark, {"a": image_of(3, 3, lambda r, c: (7, 7, 7, 7, 7))})
    assert {r["stddev"] for r in stats.image_stddev(rows).collect()} == {0.0}


def test_spread_of_large_values(spark):
    """Double sums of squares would lose this spread altogether."""
    image = image_of(40, 40, lambda r, c: [2_000_000_000 + (r + c) % 2] * 5)
    rows = raster_rows(spark, {"a": image})
    assert stats.image_stddev(rows, Grid(tile_rows=1)).first()["stddev"] == pytest.approx(0.5)


def test_first_row(spark):
    rows = stack_rows(spark, {"b": noisy_image(4, 3, 3), "a": noisy_image(5, 3, 3)})
    assert stats.first_row(rows).first()[:2] == ("a", 0)


def test_stack_is_an_inner_join(spark):
    rows = raster_rows(spark, {"a": noisy_image(6, 6, 4)}).drop("band_id")
    images = {b: rows.where(f"band = '{b}'") for b in BANDS}
    images["coarse1"] = images["coarse1"].where("row_key <> 2")
    images["fine2"] = images["fine2"].union(images["fine2"].where("row_key = 3"))
    stack = layout.assemble_stack(**images)
    assert sorted(r["row_key"] for r in stack.collect()) == [0, 1, 3, 3, 4, 5]
    repeats = layout.repeated_lines(images["fine2"]).collect()
    assert [(r["row_key"], r["copies"]) for r in repeats] == [(3, 2)]


def test_range_layout(spark):
    rows = stack_rows(spark, {"a": noisy_image(7, 40, 3)}).repartition(5)
    parts = layout.range_layout(rows, 4).rdd.glom().collect()
    keys = [[r["row_key"] for r in part] for part in parts if part]
    assert len(keys) > 1
    assert all(k == sorted(k) for k in keys)
    assert [k for part in keys for k in part] == list(range(40))


def test_regression(spark):
    points = [("a", float(x), 3.0 + 2.0 * x + (x % 3)) for x in range(12)]
    points += [("one", 1.0, 2.0), ("flat", 4.0, 1.0), ("flat", 4.0, 9.0), ("a", None, 1.0)]
    frame = spark.createDataFrame(points, "g string, x double, y double")
    fits = {r["g"]: r for r in regression.regression_fit(frame, "x", "y", ["g"]).collect()}
    wanted = statistics.linear_regression(*zip(*[(x, y) for g, x, y in points[:12]]))
    assert fits["a"]["slope"] == pytest.approx(wanted.slope)
    assert fits["a"]["intercept"] == pytest.approx(wanted.intercept)
    assert fits["a"]["n"] == 12
    assert fits["one"]["slope"] is None and fits["flat"]["intercept"] is None


def test_regression_evaluated(spark):
    points = [("a", float(x), 1.0 + 0.5 * x) for x in range(5)] + [("one", 3.0, 4.0)]
    frame = spark.createDataFrame(points, "g string, x double, y double")
    fit = regression.regression_fit(frame, "x", "y", ["g"])
    rows = regression.regression_eval(frame, fit, "x", ["g"]).collect()
    assert len(rows) == 6
    for row in rows:
        if row["g"] == "one":
            assert row["yhat"] is None
        else:
            assert row["yhat"] == pytest.approx(row["y"])


def test_packed_lines_have_the_same_statistics(spark):
    images = {"a": noisy_image(8, 9, 7), "b": image_of(3, 2, lambda r, c: [-2_000_000_000 - r] * 5)}
    rows = raster_rows(spark, images)
    grid = Grid(tile_rows=2)
    for measure in (stats.image_stddev, lambda r, g: stats.scene_limits(r, 4, g)):
        assert sorted(measure(rows, grid).collect()) == sorted(
            measure(pack_rows(rows), grid).collect()
        )
