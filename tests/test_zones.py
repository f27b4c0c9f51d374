"""Zones that a full partition cannot test: concave, with a hole, overlapping, with edges through cell centres."""

import math

import pytest
from pyspark.sql import functions as F

from rastermill.functions import grid as gr
from rastermill.operators import agreement as ag
from rastermill.operators import cells as ce
from rastermill.operators import truth as tr
from rastermill.operators import zonal as zo
from rastermill.operators import zones as zn
from rastermill.sources import products as so

W, H = 12, 9
SHAPES = {
    "concave": [[(2, 1), (20, 1), (11, 9), (20, 17), (2, 17)]],
    "hole": [[(1, 1), (19, 1), (19, 15), (1, 15)], [(5, 5), (11, 5), (11, 11), (5, 11)]],
    "beyond": [[(-7, -3), (9, -3), (9, 7), (-7, 7)]],
    "sliver": [[(4, 2), (6, 2), (6, 2), (4, 2)]],
    "two parts": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(15, 12), (23, 10), (23, 18)]],
}


@pytest.fixture(scope="module")
def edges(spark):
    rings = [(z, None, [(float(x), float(y)) for x, y in ring]) for z, parts in SHAPES.items() for ring in parts]
    rings.append(("closed", "p", [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 2.0)]))
    return so.ring_edges(spark.createDataFrame(rings, so.RINGS))


def inside(shape, row, col):
    """Ray casting."""
    x, y, odd = 2 * col + 1, 2 * row + 1, False
    for ring in shape:
        for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if ya > yb:
                xa, ya, xb, yb = xb, yb, xa, ya
            if ya <= y < yb and xa + (y - ya) * (xb - xa) / (yb - ya) > x:
                odd = not odd
    return odd


def grid_cells(spark, value="cast(row * 100 + col as double)"):
    return spark.range(W * H).select(F.expr(f"cast(id div {W} as int)").alias("row"), (F.col("id") % W).cast("int").alias("col")).withColumn("value", F.expr(value))


@pytest.mark.parametrize("bin", [1, 5, 256])
def test_spans_agree_with_ray_casting(spark, edges, bin):
    spans = zn.scanline_spans(edges, W, H, bin)
    got = {(r.zone_id, r.row, r.col) for r in zn.assign_zones(grid_cells(spark), spans, bin).collect()}
    shapes = SHAPES | {"closed": [[(2, 2), (8, 2), (8, 8)]]}
    assert got == {(z, i, j) for z, s in shapes.items() for i in range(H) for j in range(W) if inside(s, i, j)}


def test_large_span_tables_are_joined_by_shuffle(spark, edges, monkeypatch):
    spans = zn.scanline_spans(edges, W, H)
    few = sorted(map(tuple, zn.assign_zones(grid_cells(spark), spans).collect()))
    monkeypatch.setattr(zn, "SMALL_SPANS", 1)
    assert sorted(map(tuple, zn.assign_zones(grid_cells(spark), spans).collect())) == few


def test_clipped_and_overlapping(spark, edges):
    assert [r.zone_id for r in zn.clipped_zones(edges, W, H).filter("clipped").collect()] == ["beyond"]
    assigned = zn.assign_zones(grid_cells(spark), zn.scanline_spans(edges, W, H))
    shapes = SHAPES | {"closed": [[(2, 2), (8, 2), (8, 8)]]}
    count = {(i, j): sum(inside(s, i, j) for s in shapes.values()) for i in range(H) for j in range(W)}
    assert {(r.row, r.col): r.zones for r in zn.overlapping_cells(assigned).collect()} == {k: n for k, n in count.items() if n > 1}


def test_zone_without_a_valid_cell(spark, edges):
    assigned = zn.assign_zones(ce.mask_nodata(grid_cells(spark, "cast(-9999 as double)"), -9999.0), zn.scanline_spans(edges, W, H))
    row = zo.zonal_stats(assigned).filter("zone_id = 'hole'").first()
    assert row.valid == 0 and row["sum"] is None and row.mean is None and row.cells > 0
    assert zo.zonal_coverage(assigned).filter("zone_id = 'hole'").first().share == 0


def test_mask_takes_sentinel_nan_and_null(spark):
    cells = spark.createDataFrame([(0, 0, -9999.0), (0, 1, float("nan")), (0, 2, None), (0, 3, 1.5)], "row int, col int, value double")
    assert [r.value for r in ce.mask_nodata(cells, "-9999.0").orderBy("col").collect()] == [None, None, None, 1.5]
    assert [r.value for r in ce.mask_nodata(cells, "NaN").orderBy("col").collect()] == [-9999.0, None, None, 1.5]


def test_duplicates_and_gaps(spark):
    cells = grid_cells(spark).filter("not (row = 3 and col = 4) and row != 7")
    cells = cells.unionByName(cells.filter("row = 3 and col = 5"))
    assert [tuple(r) for r in ce.duplicate_cells(cells, W).collect()] == [(3, 5, 2)]
    assert {tuple(r) for r in ce.missing_cells(cells, W, H).collect()} == {(3, 4), *((7, c) for c in range(W))}
    assert ce.missing_cells(grid_cells(spark), W, H).count() == 0


def test_blocks_at_a_ragged_border(spark):
    cells = grid_cells(spark)
    blocks = {(r.row, r.col): (r.value, r.valid) for r in ce.block_aggregate(cells, 5).collect()}
    assert sum(v for v, _ in blocks.values()) == sum(r.value for r in cells.collect()) and blocks[(1, 2)][1] == 4 * 2
    tiles = so.cells_to_tiles(cells, 10, 10)
    assert {(r.row, r.col): (r.value, r.valid) for r in ce.block_aggregate_tiles(tiles, 10, 10, 5).filter("valid > 0").collect()} == blocks
    inside = ce.block_aggregate_tiles(tiles, 10, 10, 5, width=W, height=H)
    assert {(r.row, r.col): (r.value, r.valid) for r in inside.collect()} == blocks
    with pytest.raises(ValueError):
        ce.block_aggregate_tiles(tiles, 10, 10, 3)


def test_tiles_with_sentinels_nulls_and_pixels_beyond_the_border(spark):
    cells = grid_cells(spark, "case when (row + col) % 3 = 0 then -9999.0 when row = 8 then cast('NaN' as double) else cast(row * 100 + col as double) end")
    masked = {(r.row, r.col): (r.value, r.valid) for r in ce.block_aggregate(ce.mask_nodata(cells, -9999.0), 2).collect()}
    stored = cells.withColumn("value", F.col("value").cast("float"))
    tiles = so.cells_to_tiles(stored, 8, 8)
    assert dict(tiles.dtypes)["values"] == "array<float>"
    # What lies beyond the grid is filled with ones, which must not count; a tile far out has no list at all.
    filled = tiles.withColumn("values", F.transform("values", lambda v: F.coalesce(v, F.lit(1.0).cast("float"))))
    filled = filled.unionByName(spark.createDataFrame([(0, 5, None)], "tile_row int, tile_col int, values array<float>"))
    got = {(r.row, r.col): (r.value, r.valid) for r in ce.block_aggregate_tiles(filled, 8, 8, 2, -9999.0, W, H).collect()}
    assert got == masked and (None, 0) in got.values()
    empty = ce.block_aggregate_tiles(spark.createDataFrame([(0, 0, None)], "tile_row int, tile_col int, values array<float>"), 4, 4, 2)
    assert [r.valid for r in empty.collect()] == [0] * 4 and ce.block_aggregate_tiles(filled.limit(0), 8, 8, 2).count() == 0


def test_tiles_hold_each_cell_once(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 0, 2.0), (0, 1, None), (0, 1, 5.0), (1, 3, float("nan")), (3, 0, None)], "row int, col int, value double")
    got = {(r.tile_row, r.tile_col): r["values"] for r in so.cells_to_tiles(cells, 2, 2).collect()}
    assert got[(0, 0)] == [3.0, 5.0, None, None] and got[(1, 0)] == [None] * 4
    assert got[(0, 1)][:3] == [None] * 3 and math.isnan(got[(0, 1)][3])
    big = spark.range(512 * 512).select(F.expr("cast(id div 512 as int)").alias("row"), F.expr("cast(id % 512 as int)").alias("col"), F.col("id").cast("float").alias("value"))
    one = so.cells_to_tiles(big, 512, 512).first()
    assert one["values"] == [float(i) for i in range(512 * 512)]


def test_reading_prunes_and_masks(spark, tmp_path, edges):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    meta = spark.createDataFrame([("p", -9999.0)], "dataset_name string, x double").select("dataset_name", F.lit("-9999.0").alias("nodata"), F.lit(W).cast("long").alias("width"), F.lit(H).cast("long").alias("height"), F.expr("named_struct('left', -180.0D, 'top', 75.0D)").alias("bounds"), F.expr("named_struct('x', 1.0D, 'y', 1.0D)").alias("resolution"))
    cells = grid_cells(spark, "case when col = 4 then -9999.0 else cast(row as double) end")
    cells.write.parquet(str(tmp_path / "cells"))
    so.cells_to_tiles(cells, 4, 4).write.parquet(str(tmp_path / "tiles"))
    extent = zn.span_extent(zn.scanline_spans(edges.filter("zone_id = 'closed'"), W, H))
    assert (extent.row0, extent.row1, extent.col0, extent.col1) == (1, 3, 1, 3)
    want = {(i, j): None if j == 4 else float(i) for i in range(1, 4) for j in range(1, 4)}
    read = so.read_cells(spark, str(tmp_path / "cells"), meta, extent)
    assert {(r.row, r.col): r.value for r in read.collect()} == want
    assert "GreaterThanOrEqual(col,1)" in read._jdf.queryExecution().toString()
    tiles = so.read_tiles(spark, str(tmp_path / "tiles"), 4, 4, meta, extent)
    assert {(r.row, r.col): r.value for r in tiles.collect()} == want
    assert "LessThanOrEqual(tile_col,0)" in tiles._jdf.queryExecution().toString()
    assert {r.value for r in so.read_cells(spark, str(tmp_path / "cells"), meta).filter("col = 4").collect()} == {None}


def test_longitudes_out_of_range_are_refused(spark):
    rings = spark.createDataFrame([("z", None, [(170.0, 0.0), (190.0, 0.0), (190.0, 5.0)])], so.RINGS)
    with pytest.raises(Exception, match="longitude out of range"):
        so.edges_to_half_cells(so.ring_edges(rings), -180, 75, 1, 1).collect()


def test_weighted_mean(spark):
    assigned = spark.createDataFrame([("z", 1.0, 1.0), ("z", 4.0, 2.0), ("z", None, 9.0), ("y", None, 1.0)], "zone_id string, value double, w double")
    got = {r.zone_id: r for r in zo.zonal_stats(assigned, F.col("w")).collect()}
    assert got["z"]["sum"] == 9.0 and got["z"].mean == 3.0 and math.isclose(got["z"]["std"], math.sqrt(2.0)) and got["y"].mean is None


def test_constant_truth_gives_null_correlation(spark):
    pairs = spark.createDataFrame([("a", "1", 1.0, 5.0), ("a", "2", 2.0, 5.0), ("a", "3", None, 5.0), ("b", "1", 1.0, 0.0)], "task string, zone_id string, prediction double, truth double")
    a, b = ag.agreement(pairs).orderBy("task").collect()
    assert a.n == 2 and a.pearson is None and a.slope is None and b.relative_error is None
    assert ag.worst_zones(pairs, 1).select("zone_id").collect()[0].zone_id == "1"


def test_spearman_with_ties(spark):
    pairs = spark.createDataFrame([("a", str(i), float(p), float(t)) for i, (p, t) in enumerate([(1, 1), (1, 2), (3, 3), (4, 3)])], "task string, zone_id string, prediction double, truth double")
    # mean ranks 1.5 1.5 3 4 and 1 2 3.5 3.5
    assert math.isclose(ag.rank_agreement(pairs).first().spearman, 4.0 / 4.5, rel_tol=1e-9)


def test_code_map_with_repeats_does_not_double_truth(spark):
    truth = spark.createDataFrame([("t", "x", 1.0), ("t", "y", 2.0)], "task string, zone_id string, truth double")
    codes = spark.createDataFrame([("x", "b"), ("x", "a")], "code string, corrected string")
    assert sorted(map(tuple, tr.correct_codes(truth, codes).collect())) == [("t", "a", 1.0), ("t", "y", 2.0)]


def test_points_on_the_border(spark):
    grid = gr.GridSpec(4, 2, -2.0, 1.0, 1.0, 1.0)
    points = spark.createDataFrame([(-2.0, 1.0), (2.0, 0.0), (1.999, -0.999), (0.0, -1.0), (None, 0.0)], "lon double, lat double")
    kept = gr.cell_of(gr.clip_to_extent(points, grid), grid).collect()
    assert [(r.row, r.col) for r in kept] == [(0, 0), (1, 3)]


def test_truth_csv_in_another_encoding(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("région,total\n11,5.5\n12,x\n".encode("latin-1"))
    got = so.read_truth(spark, str(tmp_path / "t.csv"), "p", {"zone_id": "région", "truth": "total"}, "ISO-8859-1")
    assert sorted(map(tuple, got.collect())) == [("p", "11", 5.5), ("p", "12", None)]


def test_empty_tables(spark, edges):
    none = grid_cells(spark).limit(0)
    spans = zn.scanline_spans(edges.limit(0), W, H)
    assert zn.span_extent(spans) is None and zn.assign_zones(none, spans).count() == 0
    assert ce.raster_summary(none).first().cells == 0 and ce.duplicate_cells(none, W).count() == 0
    assert ce.missing_cells(none, W, H).count() == W * H
