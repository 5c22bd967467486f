import struct
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from gridfuse.functions import packing, pixels
from gridfuse.operators.layout import assemble_stack, pixels_long
from gridfuse.plans.fuse import fuse
from gridfuse.sources import store, wide
from rasters import cells_of, image_of, lines_of, noisy_image, raster_rows, stack_rows


def write_wide_file(path, lines, index=True):
    """A file as the converter of TIFF images leaves it."""
    cols = len(lines[0])
    columns = {str(c): pa.array([float(line[c]) for line in lines]) for c in range(cols)}
    columns[str(cols)] = pa.array([float(r) for r in range(len(lines))])
    if index:
        columns["__index_level_0__"] = pa.array(range(len(lines)), pa.int64())
    pq.write_table(pa.table(columns), str(path), compression="GZIP", use_dictionary=False)
    return str(path)


def lines_in(rows):
    return {r["row_key"]: r["pixels"] for r in rows.collect()}


@pytest.mark.parametrize("index", (True, False))
def test_wide_file(spark, tmp_path, index):
    path = write_wide_file(tmp_path / "a.parquet", [[1, 2, 3], [4, 5, 6]], index)
    rows = wide.read_image(spark, path, "fine1", "x")
    assert lines_in(rows) == {0: [1, 2, 3], 1: [4, 5, 6]}
    assert rows.select("scene", "band").distinct().collect() == [("x", "fine1")]


def test_cells_that_are_no_numbers(spark, tmp_path):
    cells = [[-2.7, 2.7, float("nan")], [1e20, float("-inf"), -0.4]]
    path = write_wide_file(tmp_path / "a.parquet", cells)
    assert lines_in(wide.read_image(spark, path, "fine1")) == {0: [-2, 2, 0], 1: [0, 0, 0]}


def test_file_without_line_numbers(spark, tmp_path):
    lines = [[r * 10 + c for c in range(4)] for r in range(50)]
    columns = {str(c): pa.array([float(line[c]) for line in lines]) for c in range(4)}
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table(columns), path, row_group_size=7)
    assert lines_in(wide.read_unnumbered_image(spark, path, "fine1")) == dict(enumerate(lines))


@pytest.mark.parametrize("broadcast", (wide.BROADCAST_FILES, 0))
def test_lines_numbered_over_many_files(spark, tmp_path, monkeypatch, broadcast):
    """Seven files of uneven length, one of them empty, in the order of their numbers."""
    monkeypatch.setattr(wide, "BROADCAST_FILES", broadcast)
    sizes, lines = [5, 1, 0, 9, 2, 7, 3], []
    for part, size in enumerate(sizes):
        own = [[100 * part + 10 * r + c for c in range(3)] for r in range(1, size + 1)]
        columns = {
            str(c): pa.array([float(line[c]) for line in own], pa.float64()) for c in range(3)
        }
        # Numbers by value: part-10 and part-11 come after part-6 to part-9.
        name = f"part-{part + 5}.parquet"
        pq.write_table(pa.table(columns), str(tmp_path / name), row_group_size=2)
        lines += own
    rows = wide.read_unnumbered_image(spark, str(tmp_path), "fine1")
    assert lines_in(rows) == dict(enumerate(lines))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "rangepartitioning" not in plan


def test_wide_roundtrip(spark, tmp_path):
    rows = raster_rows(spark, {"a": noisy_image(1, 6, 5)}).where("band = 'fine2'")
    path = str(tmp_path / "wide")
    store.write_wide(wide.wide_from_rows(rows, 7), path)
    written = spark.read.parquet(path)
    assert written.columns == [*map(str, range(8)), "__index_level_0__"]
    wanted = {k: v + [0, 0] for k, v in lines_in(rows).items()}
    assert lines_in(wide.read_image(spark, path, "fine2")) == wanted
    part = next((tmp_path / "wide").glob("*.parquet"))
    column = pq.ParquetFile(part).metadata.row_group(0).column(0)
    assert column.compression == "GZIP"
    assert not any("DICTIONARY" in e for e in column.encodings)


def test_fusion_of_five_files(spark, tmp_path):
    image = noisy_image(2, 9, 8)
    lines = lines_of(image)
    paths = {
        band: write_wide_file(
            tmp_path / f"{band}.parquet", [[cell[k] for cell in lines[r]] for r in sorted(lines)]
        )
        for k, band in enumerate(brute.BANDS)
    }
    fused = fuse(wide.read_images(spark, **paths))
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan
    found, wanted = cells_of(fused)["s0"], brute.fuse(image)
    assert set(found) == set(wanted)
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_lines_stored_and_read(spark, tmp_path):
    image = noisy_image(3, 20, 4)
    stack = stack_rows(spark, {"a": image, "b": image})
    for n, partitions in enumerate((None, 3)):
        path = str(tmp_path / str(n))
        store.write_lines(stack, path, partitions)
        assert sorted(spark.read.parquet(path).collect()) == sorted(stack.collect())


def test_bands_stored_apart(spark, tmp_path):
    rows = raster_rows(spark, {"a": noisy_image(4, 9, 6)})
    path = str(tmp_path / "rows")
    store.write_lines(packing.pack_rows(rows), path, 2)
    stored = spark.read.parquet(path)
    assert sorted(packing.unpack_rows(stored).select(rows.columns).collect()) == sorted(
        rows.collect()
    )
    assert "PartitionFilters: [isnotnull(band" in (
        stored.where("band = 'fine1'")._jdf.queryExecution().executedPlan().toString()
    )
    agree = cells_of(fuse(stored))["a"], cells_of(fuse(rows))["a"]
    assert agree[0] == pytest.approx(agree[1])


def test_shared_folder(spark):
    assert store.shared_folder(spark) != store.shared_folder(spark)

    def session(master, **settings):
        context = SimpleNamespace(master=master)
        return SimpleNamespace(conf=settings, sparkContext=context)

    named = session("yarn", **{"spark.checkpoint.dir": "/shared/checkpoints/"})
    assert store.shared_folder(named).startswith("/shared/checkpoints/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(session("yarn"))


def test_packed_lines(spark):
    lines = [("a", 3, [1, -2, 2147483647]), ("a", 4, []), ("a", 5, [0, -2147483648, 7])]
    rows = spark.createDataFrame(lines, "scene string, row_key int, px array<int>")
    packed = rows.select("row_key", packing.pack_line("px", "row_key").alias("blob"))
    for row, (_, key, px) in zip(packed.orderBy("row_key").collect(), lines):
        assert bytes(row["blob"]) == struct.pack(f">{len(px) + 1}i", *px, key)
    back = packed.select(
        packing.packed_line_number("blob").alias("k"), packing.unpack_line("blob").alias("px")
    )
    assert {r["k"]: r["px"] for r in back.collect()} == {k: px for _, k, px in lines}


def test_packed_result(spark):
    lines = [(1, [1.5, -2.25, 1e-3]), (2, []), (3, [400.123456])]
    rows = spark.createDataFrame(lines, "row_key int, px array<double>")
    packed = rows.select("row_key", packing.pack_fused("px").alias("blob")).orderBy("row_key")
    for row, (_, px) in zip(packed.collect(), lines):
        assert bytes(row["blob"]) == struct.pack(f">{len(px)}f", *px)
    back = packed.select("row_key", packing.unpack_fused("blob").alias("px")).collect()
    for row, (_, px) in zip(back, lines):
        assert row["px"] == pytest.approx(px, rel=1e-6)


def test_single_cell(spark):
    rows = spark.createDataFrame([([5, 6],)], "px array<int>")
    cells = rows.select(*[pixels.cell_at("px", c).alias(f"c{c}") for c in (0, 1, 2)]).first()
    assert tuple(cells) == (5, 6, 0)


def test_pixels_long(spark):
    image = image_of(3, 4, lambda r, c: (r, c, r + c, r * c, 1))
    found = pixels_long(stack_rows(spark, {"a": image})).collect()
    assert {(r["row_key"], r["col"]): tuple(r)[3:] for r in found} == image
    assert len(found) == len(image)


def test_truncation_of_a_column(spark):
    rows = spark.createDataFrame([(2.9,), (-2.9,), (float("nan"),), (None,)], "x double")
    found = rows.select(pixels.to_digital_number("x").alias("x"), F.lit(1)).collect()
    assert [r["x"] for r in found] == [2, -2, 0, 0]


def test_stored_images_join_without_an_exchange(spark, tmp_path):
    image = noisy_image(5, 30, 6)
    rows = raster_rows(spark, {"a": image, "b": image})
    images = {}
    for band in brute.BANDS:
        table = f"stored_{band}"
        own = rows.where(F.col("band") == band)
        store.write_bucketed(own, table, 4, str(tmp_path / band))
        images[band] = store.read_bucketed(spark, table)
        files = list((tmp_path / band).glob("*.parquet"))
        assert 1 <= len(files) <= 4
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stack = assemble_stack(**images)
        plan = stack._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        found = {(r["scene"], r["row_key"]): r["coarse2"] for r in stack.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for band in brute.BANDS:
            spark.sql(f"DROP TABLE stored_{band}")
    lines = lines_of(image)
    assert found == {(s, r): [cell[3] for cell in lines[r]] for s in "ab" for r in lines}
