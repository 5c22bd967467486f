import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import brute
from gridfuse.functions.packing import pack_rows, unpack_fused
from gridfuse.operators.layout import stack_images
from gridfuse.plans.fuse import fuse, fuse_parts, fused_preview, fused_rows
from gridfuse.schema import BANDS, FUSED, Grid
from rasters import cells_of, image_of, noisy_image, raster_rows

ENGINES = ("arrow", "expr")
SMALL = Grid(tile_rows=4, tile_cols=3)


def agree(found, wanted):
    assert set(found) == set(wanted)
    for cell, value in wanted.items():
        assert found[cell] == pytest.approx(value, rel=1e-9, abs=1e-6), cell


def check(spark, images, **options):
    """Both engines, on small tiles, against plain Python."""
    lines = raster_rows(spark, images)
    for engine in ENGINES:
        found = cells_of(fuse(lines, grid=SMALL, engine=engine, **options))
        for scene, image in images.items():
            agree(found[scene], brute.fuse(image, **options))


def test_noisy_scenes(spark):
    check(spark, {"a": noisy_image(1, 9, 11), "b": noisy_image(2, 5, 7)})


@pytest.mark.parametrize(
    "options",
    [{"slope": "fine_on_coarse"}, {"zero_change": "zero"}, {"num_class": 2}],
    ids=str,
)
def test_options(spark, options):
    check(spark, {"a": noisy_image(3, 7, 8)}, **options)


@pytest.mark.parametrize("engine", ENGINES)
def test_window_of_three(spark, engine):
    image = noisy_image(4, 7, 8)
    grid = Grid(window=3, tile_rows=3, tile_cols=4)
    found = cells_of(fuse(raster_rows(spark, {"a": image}), grid=grid, engine=engine))
    agree(found["a"], brute.fuse(image, window=3))


def test_hand_worked_images(spark):
    """6 by 6 cells, one image per case."""

    def cells(make):
        return image_of(6, 6, make)

    images = {
        "constant": cells(lambda r, c: (10, 20, 10, 20, 15)),
        "no_data": cells(lambda r, c: (0 if (r, c) == (2, 2) else 10 + r, 20 + r, 10, 20, 14)),
        "edges": cells(lambda r, c: (10 + c, 20 + c, 10 + r, 20 + r, 15 + r)),
        "opposed": cells(lambda r, c: (10 + r, 20 + r, 30, 20, 26)),
        "undefined": cells(lambda r, c: (10 + r, 10 + r, 30, 20, 26)),
        "as_at_m": cells(lambda r, c: (10 + r, 20 + c, 30, 40, 30)),
        "as_at_n": cells(lambda r, c: (10 + r, 20 + c, 30, 40, 40)),
        "as_at_both": cells(lambda r, c: (10 + r, 20 + c, 30, 30, 30)),
    }
    for zero_change in ("limit", "zero"):
        check(spark, images, zero_change=zero_change)


@pytest.mark.parametrize("engine", ENGINES)
def test_values_worked_by_hand(spark, engine):
    images = {
        # Same change everywhere and slope 1: midway between the dates.
        "constant": image_of(6, 6, lambda r, c: (10, 20, 10, 20, 15)),
        # No coarse change: half of each date.
        "still": image_of(6, 6, lambda r, c: (10 + r, 20 + c, 7, 7, 7)),
        # As at date m: that date alone.
        "as_at_m": image_of(6, 6, lambda r, c: (10 + r, 20 + c, 30, 40, 30)),
    }
    found = cells_of(fuse(raster_rows(spark, images), grid=SMALL, engine=engine))
    assert found["constant"][0, 0] == pytest.approx(15)
    assert found["constant"][5, 5] == pytest.approx(15)
    assert found["still"][2, 3] == pytest.approx(0.5 * 12 + 0.5 * 23)
    assert found["as_at_m"][1, 4] == pytest.approx(11)


def test_missing_line(spark):
    image = {k: v for k, v in noisy_image(5, 10, 6).items() if k[0] not in (3, 4)}
    check(spark, {"a": image})


def test_short_last_line(spark):
    image = {k: v for k, v in noisy_image(6, 6, 9).items() if k[0] < 5 or k[1] < 4}
    check(spark, {"a": image})


@pytest.mark.parametrize("engine", ENGINES)
def test_line_that_one_band_lacks_drops_out(spark, engine):
    image = noisy_image(7, 8, 5)
    lines = raster_rows(spark, {"a": image}).where("band <> 'coarse2' or row_key <> 4")
    found = cells_of(fuse(lines, grid=SMALL, engine=engine))["a"]
    rest = {k: v for k, v in image.items() if k[0] != 4}
    # The thresholds come from the fine images alone, which have all lines.
    limits = brute.thresholds(image)
    kept, brute.thresholds = brute.thresholds, lambda *_: limits
    try:
        agree(found, brute.fuse(rest))
    finally:
        brute.thresholds = kept


@pytest.mark.parametrize("engine", ENGINES)
def test_repeated_line_is_an_error(spark, engine):
    lines = raster_rows(spark, {"a": noisy_image(8, 4, 5)})
    twice = lines.union(lines.where("band = 'fine2' and row_key = 1"))
    with pytest.raises(Exception, match="occurs more than once"):
        fuse(twice, engine=engine).collect()


@pytest.mark.parametrize("engine", ENGINES)
def test_uneven_bands_are_an_error(spark, engine):
    image = noisy_image(9, 4, 5)
    lines = raster_rows(spark, {"a": image})
    cut = lines.selectExpr(
        "scene",
        "band",
        "row_key",
        "if(band = 'coarse1' and row_key = 2, slice(pixels, 1, 3), pixels) as pixels",
    )
    with pytest.raises(Exception, match="differ in length"):
        fuse(cut, engine=engine).collect()


@pytest.mark.parametrize("engine", ENGINES)
def test_layout_does_not_matter(spark, engine):
    image = noisy_image(10, 13, 10)
    wanted = brute.fuse(image)
    grids = (
        Grid(),
        Grid(tile_cols=None),
        Grid(tile_rows=1, tile_cols=1),
        Grid(tile_rows=2, tile_cols=7, partitions=3),
        Grid(tile_rows=5, tile_cols=None, partitions=1),
    )
    for seed, grid in enumerate(grids):
        lines = raster_rows(spark, {"a": image}, shuffle=seed).repartition(seed + 1)
        agree(cells_of(fuse(lines, grid=grid, engine=engine))["a"], wanted)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    seed=st.integers(0, 10**6),
    rows=st.integers(1, 7),
    cols=st.integers(1, 7),
    tile_rows=st.integers(1, 5),
    tile_cols=st.integers(1, 5),
)
def test_any_image(spark, seed, rows, cols, tile_rows, tile_cols):
    image = noisy_image(seed, rows, cols, no_data=0.2)
    grid = Grid(tile_rows=tile_rows, tile_cols=tile_cols)
    lines = raster_rows(spark, {"a": image})
    for engine in ENGINES:
        agree(cells_of(fuse(lines, grid=grid, engine=engine))["a"], brute.fuse(image))


def test_adding_a_constant_adds_it_to_the_result(spark):
    image = noisy_image(11, 8, 9, no_data=0)
    moved = {k: tuple(x + 500 for x in v) for k, v in image.items()}
    found = cells_of(fuse(raster_rows(spark, {"a": image, "b": moved}), grid=SMALL))
    for cell, value in found["a"].items():
        assert found["b"][cell] == pytest.approx(value + 500, abs=1e-6)


def test_large_values(spark):
    """Sums of products beyond the exact range of a double."""
    rnd = random.Random(12)
    image = image_of(5, 6, lambda r, c: [50_000_000 + rnd.randint(0, 99) for _ in range(5)])
    found = cells_of(fuse(raster_rows(spark, {"a": image}), grid=SMALL, engine="expr"))
    wanted = brute.fuse(image)
    for cell, value in wanted.items():
        assert found["a"][cell] == pytest.approx(value, rel=1e-7)


def test_empty_input(spark):
    lines = raster_rows(spark, {"a": noisy_image(13, 3, 3)}).where("false")
    for engine in ENGINES:
        assert fuse(lines, engine=engine).count() == 0


def test_images_as_separate_tables(spark):
    image = noisy_image(14, 6, 6)
    lines = raster_rows(spark, {"a": image})
    images = {b: lines.where(f"band = '{b}'") for b in BANDS}
    agree(cells_of(fuse(stack_images(**images), grid=SMALL))["a"], brute.fuse(image))
    with pytest.raises(ValueError):
        stack_images(fine1=lines)


def test_stored_form_and_preview(spark):
    fused = fuse(raster_rows(spark, {"a": noisy_image(15, 30, 4)}))
    assert fused_rows(fused).schema.simpleString() == FUSED.simpleString()
    assert [r["row_key"] for r in fused_preview(fused).collect()] == list(range(20))


def test_wrong_options(spark):
    lines = raster_rows(spark, {"a": noisy_image(16, 3, 3)})
    for options in ({"slope": "x"}, {"zero_change": "x"}, {"engine": "x"}):
        with pytest.raises(ValueError):
            fuse_parts(lines, **options)
    with pytest.raises(ValueError):
        Grid(window=1)


@pytest.mark.parametrize("engine", ENGINES)
def test_packed_lines_give_the_same(spark, engine):
    images = {"a": noisy_image(17, 9, 11), "b": {k: v for k, v in noisy_image(18, 6, 9).items()
                                                 if k[0] < 5 or k[1] < 4}}
    lines = raster_rows(spark, images)
    for grid in (SMALL, Grid(tile_rows=3, tile_cols=None)):
        packed = fuse(pack_rows(lines), grid=grid, engine=engine, packed=True)
        assert packed.schema["pixels"].dataType.simpleString() == "binary"
        found = cells_of(packed.withColumn("pixels", unpack_fused("pixels")))
        for scene, image in images.items():
            wanted = brute.fuse(image)
            assert set(found[scene]) == set(wanted)
            for cell, value in wanted.items():
                assert found[scene][cell] == pytest.approx(value, rel=1e-6)


def tile_exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange hash" in line and "tile_col" in line]


@pytest.mark.parametrize("engine", ENGINES)
def test_without_any_broadcast(spark, engine):
    """The plan for tables of thresholds too large to broadcast: still one exchange of the cells."""
    image = noisy_image(19, 9, 7)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = raster_rows(spark, {"a": image, "b": image})
        fused = fuse_parts(lines, grid=Grid(tile_rows=4, tile_cols=None), engine=engine)
        plan = fused._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SinglePartition" not in plan
        # One for the cells, one for the list of tiles.
        assert len(tile_exchanges(plan)) == 2
        agree(cells_of(fused)["b"], brute.fuse(image))
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_tile_in_several_arrow_batches(spark):
    image = noisy_image(20, 12, 6)
    lines = raster_rows(spark, {"a": image})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for rows in (lines, pack_rows(lines)):
            agree(cells_of(fuse(rows))["a"], brute.fuse(image))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
