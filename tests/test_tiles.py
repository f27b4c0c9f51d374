"""Tiles, exact totals, bitmaps, cells in place, overlaps, borders and GeoJSON, by hand and against plain versions."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastermill.functions import fixed as fx
from rastermill.functions import grid as gr
from rastermill.jobs import validation as va
from rastermill.operators import cells as ce
from rastermill.operators import tiles as ti
from rastermill.operators import truth as tr
from rastermill.operators import zonal as zo
from rastermill.operators import zones as zn
from rastermill.sources import geojson
from rastermill.sources import products as so
from tests.test_zones import SHAPES, H, W, edges, grid_cells, inside  # noqa: F401

MIXED = "case when (row + col) % 4 = 0 then -9999.0 when row = 8 and col < 5 then cast('NaN' as double) when col = 6 then null else cast(row * 1000.25 - col * 7.5 as double) end"
STATS = ("cells", "valid", "sum", "mean", "min", "max", "std")


def by_zone(df):
    return {r.zone_id: tuple(r[c] for c in STATS) for r in df.collect()}


@pytest.mark.parametrize("size", [(5, 4), (12, 9), (64, 64), (1, 1), (3, 9)])
def test_totals_from_tiles_are_those_of_cells(spark, edges, size):  # noqa: F811
    cells, spans = grid_cells(spark, MIXED), zn.row_spans(edges, W, H)
    want = by_zone(zo.exact_zonal_stats(zn.assign_zones(ce.mask_nodata(cells, -9999.0), zn.in_bins(spans))))
    tiles = so.cells_to_tiles(cells, *size)
    # Pixels beyond the grid hold values that must not count; a tile without a list has no cells.
    tiles = tiles.withColumn("values", F.transform("values", lambda v, k: F.when((k % size[0] + F.col("tile_col") * size[0] >= W) | (F.floor(k / size[0]) + F.col("tile_row") * size[1] >= H), F.lit(1e6)).otherwise(v)))
    tiles = tiles.unionByName(spark.createDataFrame([(0, 99, None)], "tile_row int, tile_col int, values array<double>"))
    assert by_zone(zo.zonal_stats_of_tiles(ti.Tiles(tiles, *size), spans, -9999.0)) == want and len(want) > 4


def test_tiles_joined_by_shuffle_and_float_pixels(spark, edges, monkeypatch):  # noqa: F811
    cells, spans = grid_cells(spark, MIXED).withColumn("value", F.col("value").cast("float")), zn.row_spans(edges, W, H)
    tiles = ti.Tiles(so.cells_to_tiles(cells, 5, 4), 5, 4)
    few = by_zone(zo.zonal_stats_of_tiles(tiles, spans, -9999.0))
    monkeypatch.setattr(ti, "SMALL_SPANS", 1)
    assert by_zone(zo.zonal_stats_of_tiles(tiles, spans, -9999.0)) == few
    with pytest.raises(Exception, match="a tile must have"):
        zo.zonal_stats_of_tiles(ti.Tiles(tiles.frame, 5, 5), spans).collect()


@pytest.mark.parametrize("n", [1, 15, 16, 37, 150])
def test_extremes_of_all_runs(n):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(3, n))
    ok = rng.random((3, n)) < 0.7
    runs = [(r, a, b) for r in range(3) for a in range(n) for b in range(a + 1, n + 1)]
    low, high = ti._Extremes(values, ok).of(*(np.array(x) for x in zip(*runs, strict=True)))
    for (r, a, b), lo, hi in zip(runs, low, high, strict=True):
        known = values[r, a:b][ok[r, a:b]]
        assert (lo, hi) == ((known.min(), known.max()) if len(known) else (np.inf, -np.inf))


def test_exact_totals_are_equal_to_the_last_bit(spark):
    random.seed(4)
    rows = [(f"z{i % 3}", random.choice([1e12, 1e-3, -7.0, 123456.789]) * random.random()) for i in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "zone_id string, value double")
    fixed = fx.Fixed(16, 0)
    with pytest.raises(Exception, match="too large"):
        zo.exact_zonal_stats(df, fx.Fixed(20, 12)).collect()
    small = df.withColumn("value", F.col("value") / 1e4)
    found = [by_zone(zo.exact_zonal_stats(x, fixed)) for x in (small, small.repartition(7), small.orderBy(F.desc("value")).coalesce(1))]
    assert found[0] == found[1] == found[2] and found[0]["none"] == (1, 0, None, None, None, None, None)
    for z in ("z0", "z1", "z2"):
        own = [v / 1e4 for k, v in rows if k == z]
        assert math.isclose(found[0][z][2], math.fsum(own), rel_tol=1e-9) and math.isclose(found[0][z][6], np.std(own, ddof=1), rel_tol=1e-6)
    sums = fx.exact_sums(small.withColumn("part", F.monotonically_increasing_id() % 5), fixed, "zone_id", "part")
    assert by_zone(fx.measures(fx.merged(sums, "zone_id"), fixed, "zone_id")) == found[0]


def test_halves_are_the_same_numbers(spark):
    values = np.array([0.0, -0.5, 1.25, -3.7, 2.0**40 + 0.3, -(2.0**41)])
    with pytest.raises(ValueError, match="too large"):
        fx.Fixed().halves(np.array([1.0, np.nan]), 20)
    upper, lower = fx.Fixed().halves(values, 20)
    want = [int(r.u) for r in spark.createDataFrame([(v,) for v in values.tolist()], "value double").select(fx.Fixed().units(F.col("value"), 20).alias("u")).collect()]
    assert [int(a) * 2**32 + int(b) for a, b in zip(upper, lower, strict=True)] == want


def test_area_weights_from_tiles(spark, edges):  # noqa: F811
    grid = gr.GridSpec(W, H, -180.0, 75.0, 1.0, 2.0)
    cells, spans = grid_cells(spark, MIXED), zn.row_spans(edges, W, H)
    assigned = zn.assign_zones(ce.mask_nodata(cells, -9999.0), zn.in_bins(spans))
    want = by_zone(zo.zonal_stats(gr.cell_area(assigned, grid), F.col("area_km2")))
    got = by_zone(zo.zonal_stats_of_tiles(ti.Tiles(so.cells_to_tiles(cells, 5, 4), 5, 4), spans, -9999.0, row_weight=gr.row_area(grid)))
    assert want.keys() == got.keys()
    for z, own in want.items():
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(own, got[z], strict=True))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 20])
@pytest.mark.parametrize("size", [(5, 4), (8, 8), (6, 6)])
def test_blocks_across_borders(spark, k, size):
    cells = grid_cells(spark, MIXED)
    want = {(r.row, r.col): (r.value, r.valid) for r in ce.block_aggregate(ce.mask_nodata(cells, -9999.0), k).collect()}
    tiles = ti.Tiles(so.cells_to_tiles(cells, *size), *size)
    found = ti.block_aggregate_any(tiles, k, -9999.0, W, H)
    got = {(r.row, r.col): (r.value, r.valid) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[b][1] == n and (v is None and got[b][0] is None or math.isclose(got[b][0], v, abs_tol=1e-6)) for b, (v, n) in want.items())
    assert ("Union" in found._jdf.queryExecution().optimizedPlan().toString()) == bool(size[0] % k or size[1] % k)


def test_only_border_blocks_are_moved(spark):
    cells = spark.range(40 * 40).select(F.expr("cast(id div 40 as int)").alias("row"), F.expr("cast(id % 40 as int)").alias("col"), F.col("id").cast("double").alias("value"))
    tiles = ti.Tiles(so.cells_to_tiles(cells, 20, 20), 20, 20)
    parts = ti._blocks(tiles, 3, None, 40, 40, False, fx.Fixed())
    # 14 x 14 blocks; one row and one column of them cross the border in the middle.
    assert parts.select("row", "col").distinct().count() == 27 and parts.count() == 2 * 27 + 1 + 1
    assert ti._blocks(tiles, 3, None, 40, 40, True, fx.Fixed()).count() == 14 * 14 - 27


def messy(spark):
    rows = [(i, j) for i in range(5) for j in range(150) if (i, j) not in {(0, 0), (1, 63), (1, 64), (4, 149)} and i != 2]
    rows += [(0, 5)] * 3 + [(3, 149), (3, 149), (0, 150), (0, 150), (7, 1), (-1, 3), (4, -2), (None, 1), (1, None), (4, 127)]
    return spark.createDataFrame(rows, "row int, col int").withColumn("value", F.lit(1.0))


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (9, 10_000), (4, 3)])
def test_bitmaps_of_messy_cells(spark, parts, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cells = messy(spark).repartition(parts)
        gone = {(0, 0), (1, 63), (1, 64), (4, 149), *((2, j) for j in range(150))}
        assert {tuple(r) for r in ce.missing_cells(cells, 150, 5).collect()} == gone
        assert {tuple(r) for r in ce.duplicate_cells(cells, 150).collect()} == {(0, 5, 4), (3, 149, 3), (4, 127, 2)} and ce.duplicate_cells(cells, 151).count() == 4
        words, seen = ce.examined(cells, lambda df: df.checkpoint())
        whole = ce.completeness(words, 150, 5).first()
        assert whole.missing_cells == len(gone) and whole.repeats == 3 + 2 + 1 + 1
        assert seen["cells"] == cells.count() == seen["valid"] and (seen["min_row"], seen["max_row"], seen["min_col"], seen["max_col"]) == (-1, 7, -2, 150)
        assert {tuple(r) for r in ce.missing_cells(cells, 150, 5, words).collect()} == gone
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_missing_cells_scan_once(spark, tmp_path):
    messy(spark).write.parquet(str(tmp_path / "cells"))
    plan = ce.missing_cells(spark.read.parquet(str(tmp_path / "cells")), 150, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "row" in plan
    from rastermill.sources.shared import settle

    cells = spark.read.parquet(str(tmp_path / "cells"))
    words, _ = ce.examined(cells, settle)
    for again in (ce.missing_cells(cells, 150, 5, words), ce.completeness(words, 150, 5)):
        assert "FileScan" not in again._jdf.queryExecution().executedPlan().toString()


def test_metrics_that_do_not_fit_are_measured_anew(spark, monkeypatch):
    class Wrong:
        get = dict.fromkeys(ce.MEASURES, 10**9)

    cells = messy(spark)
    monkeypatch.setattr(ce, "Observation", Wrong)
    monkeypatch.setattr(type(cells), "observe", lambda self, *_: self)
    assert ce.examined(cells, lambda df: df.checkpoint())[1]["cells"] == cells.count()


def test_cells_in_place_for_many_spans(spark, tmp_path, edges):  # noqa: F811
    cells = zn.write_cells_by_row(grid_cells(spark), "cells_in_place", str(tmp_path / "cells"), 4)
    found = zn.assign_zones_by_row(cells, zn.row_spans(edges, W, H))
    shapes = SHAPES | {"closed": [[(2, 2), (8, 2), (8, 8)]]}
    assert {(r.zone_id, r.row, r.col) for r in found.collect()} == {(z, i, j) for z, s in shapes.items() for i in range(H) for j in range(W) if inside(s, i, j)}
    # More than a million spans: only they are moved.
    many = spark.range(1_100_000).select(F.concat(F.lit("z"), F.col("id") % 997).alias("zone_id"), F.expr(f"cast(id % {H} as int)").alias("row"), F.expr(f"cast(id % {W} as int)").alias("c0")).withColumn("c1", F.col("c0") + 1)
    sides = zn.assign_zones_by_row(cells, many)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    cell_side = sides[: sides.index("Range") if "Range" in sides else None]
    assert "FileScan parquet" in sides and "Bucketed: true" in sides
    at = sides.index("FileScan parquet")
    assert "Exchange" not in cell_side[:at]
    spark.sql("DROP TABLE cells_in_place")


def test_overlaps_without_cells(spark, edges):  # noqa: F811
    spans = zn.row_spans(edges, W, H)
    runs = zn.overlap_runs(zn.in_bins(spans, 3))
    want = {(r.row, r.col): r.zones for r in zn.overlapping_cells(zn.assign_zones(grid_cells(spark), zn.in_bins(spans))).collect()}
    assert {(r.row, c): r.zones for r in runs.collect() for c in range(r.c0, r.c1)} == want
    shapes = SHAPES | {"closed": [[(2, 2), (8, 2), (8, 8)]]}
    shared = {z: sum((i, j) in want for i in range(H) for j in range(W) if inside(s, i, j)) for z, s in shapes.items()}
    assert {r.zone_id: r.shared for r in zn.overlap_by_zone(spans, runs).collect()} == {z: n for z, n in shared.items() if n}


def test_long_edges_are_dealt_by_stripe(spark, monkeypatch):
    tall = spark.createDataFrame([("a", None, [(1.0, -50.0), (9.0, 2050.0), (3.0, 2050.0)])], so.RINGS)
    e = so.ring_edges(tall)
    want = sorted(map(tuple, zn.row_spans(e, 8, 1000).collect()))
    plan = zn.row_spans(e, 8, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "stripe" in plan
    for rows in (1, 7, 5000):
        monkeypatch.setattr(zn, "STRIPE", rows)
        assert sorted(map(tuple, zn.row_spans(e, 8, 1000).collect())) == want


def area_on_grid(ring, n=400):
    """Share of many points of the ring's box that lie in it, and on the grid."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    gx, gy = (np.linspace(min(v), max(v), n, endpoint=False) + (max(v) - min(v)) / (2 * n) for v in (xs, ys))
    x, y = np.meshgrid(gx, gy)
    odd = np.zeros(x.shape, bool)
    for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ya != yb:
            odd ^= ((ya <= y) & (y < yb) | (yb <= y) & (y < ya)) & (xa + (y - ya) * (xb - xa) / (yb - ya) > x)
    box = (max(xs) - min(xs)) * (max(ys) - min(ys))
    return box * odd.mean(), box * (odd & (x >= 0) & (x <= 2 * W) & (y >= 0) & (y <= 2 * H)).mean()


def test_share_outside(spark):
    rings = {"in": [(1, 1), (5, 1), (5, 5)], "corner": [(-4, -6), (6, -6), (6, 4), (-4, 4)], "slant": [(-5, 3), (10, -9), (40, 15), (20, 30)], "around": [(-3, -3), (50, -3), (50, 40), (-3, 40)], "gone": [(30, 2), (40, 2), (35, 9)], "star": [(-2, 9), (30, 1), (4, 17), (12, -5), (22, 25)]}
    df = spark.createDataFrame([(z, None, [(float(x), float(y)) for x, y in r]) for z, r in rings.items()], so.RINGS)
    got = {r.zone_id: r for r in zn.outside_share(df, W, H).collect()}
    for z in ("in", "corner", "slant", "around", "gone"):
        whole, held = area_on_grid(rings[z])
        assert math.isclose(got[z].area, whole / 4, rel_tol=0.02) and math.isclose(got[z].inside, held / 4, rel_tol=0.02, abs_tol=0.05)
    assert got["in"].outside == 0 and got["gone"].outside == 1 and math.isclose(got["corner"].outside, 1 - 24 / 100)
    backwards = df.withColumn("ring", F.reverse("ring"))
    assert {r.zone_id: round(r.outside, 9) for r in zn.outside_share(backwards, W, H).collect()} == {z: round(r.outside, 9) for z, r in got.items()}
    # A hole, flagged or turned the other way.
    outer, hole = [(-4.0, 2.0), (8.0, 2.0), (8.0, 14.0), (-4.0, 14.0)], [(-2.0, 4.0), (6.0, 4.0), (6.0, 12.0), (-2.0, 12.0)]
    flagged = spark.createDataFrame([("h", None, 0, False, outer), ("h", None, 0, True, hole)], geojson.RINGS)
    turned = spark.createDataFrame([("h", None, outer), ("h", None, hole[::-1])], so.RINGS)
    for r in (zn.outside_share(flagged, W, H).first(), zn.outside_share(turned, W, H).first()):
        assert (r.area, r.inside) == ((144 - 64) / 4, (8 * 12 - 6 * 8) / 4)
    flat = spark.createDataFrame([("f", None, [(0.0, 0.0), (4.0, 0.0), (8.0, 0.0)])], so.RINGS)
    assert zn.outside_share(flat, W, H).first().outside is None


def feature(zone, kind, coordinates, **more):
    return {"type": "Feature", "properties": {"iso": zone, "adm0": "p", "n": 7}, "geometry": {"type": kind, "coordinates": coordinates}} | more


SQUARE, HOLE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]


def test_geojson(spark, tmp_path):
    good = [feature("a", "Polygon", [SQUARE, HOLE]), feature("b", "MultiPolygon", [[SQUARE], [[[9, 9, 100], [10, 9], [10, 10], [9, 9, 100]]]]), feature("a", "Polygon", [HOLE], id=3, bbox=[0, 1])]
    bad = [feature(None, "Polygon", [SQUARE]), feature("c", "Point", [1, 2]), feature("c", "Polygon", [SQUARE[:-1]]), feature("c", "Polygon", [SQUARE, [[0, 0], [1, 1], [0, 0]]]), feature("c", "Polygon", [[[0, 0], [200, 0], [200, 9], [0, 0]]]), feature("c", "Polygon", []), feature("c", "Polygon", [[]]), feature("c", "MultiPolygon", [SQUARE]), {"type": "Feature", "properties": {"iso": "d"}, "geometry": None}, {"type": "Other"}]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": good + bad}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, good + bad)) + "\n{broken\n")
    want = [("a", "p", 0, False, 3), ("a", "p", 0, False, 4), ("a", "p", 0, True, 3), ("b", "p", 0, False, 4), ("b", "p", 1, False, 3)]
    for path, by_line in (("all.json", False), ("lines.json", True)):
        rings, faults = geojson.read_geojson(spark, str(tmp_path / path), "iso", "adm0", by_line)
        assert sorted((r.zone_id, r.parent_id, r.part, r.hole, len(r.ring)) for r in rings.collect()) == want
        assert {r.fault: r.features for r in faults.collect()} == {"no zone": 1, "no polygon": 1, "bad ring": 5, "no coordinates": 1, "no geometry": 1, "no feature": 1 + by_line}
    empty = tmp_path / "none.json"
    empty.write_text('{"type": "FeatureCollection", "features": []}')
    assert geojson.read_geojson(spark, str(empty), "iso")[0].count() == 0


def test_grids_that_do_not_nest(spark):
    def meta(width, height, x, y, crs="EPSG:4326", left=-180.0):
        return spark.createDataFrame([("m", None, None, None, crs, None, None, width, height, 1, (left, -65.0, 180.0, 75.0), (x, y))], so.METADATA)

    a = meta(360, 140, 1.0, 1.0)
    assert gr.nesting_of(a, meta(180, 70, 2.0, 2.0)) == gr.Nesting(2, 2, "a") and gr.nesting_of(meta(120, 70, 3.0, 2.0), a) == gr.Nesting(3, 2, "b") and gr.nesting_of(a, a) == gr.Nesting(1, 1, "a")
    for other in (meta(240, 140, 1.5, 1.0), meta(180, 280, 2.0, 0.5), meta(180, 70, 2.0, 2.0, "EPSG:3857"), meta(180, 70, 2.0, 2.0, left=-179.0), meta(181, 70, 2.0, 2.0)):
        with pytest.raises(ValueError):
            gr.nesting_of(a, other)


def test_code_map_and_parent_together(spark, tmp_path, edges):  # noqa: F811
    square = lambda x, y: [(-180.0 + x, 75.0 - y), (-180.0 + x + 2, 75.0 - y), (-180.0 + x + 2, 75.0 - y - 2), (-180.0 + x, 75.0 - y - 2)]
    rings = [("1", "p", square(0, 0)), ("2", "p", square(2, 0)), ("3", "q", square(4, 0))]
    spark.createDataFrame(rings, so.RINGS).write.parquet(str(tmp_path / "rings"))
    grid_cells(spark).write.parquet(str(tmp_path / "cells"))
    (tmp_path / "meta.json").write_text(json.dumps({"dataset_name": "m", "crs": "EPSG:4326", "width": W, "height": H, "nodata": -9999.0, "bounds": {"left": -180.0, "bottom": 75.0 - H, "right": -180.0 + W, "top": 75.0}, "resolution": {"x": 1.0, "y": 1.0}}, indent=1))
    (tmp_path / "truth.csv").write_text("code,total\nold1,202\nold2,210\n3,1\nzz,5\n2,n/a\n")
    product = va.Product(str(tmp_path / "meta.json"), str(tmp_path / "cells"))
    codes = spark.createDataFrame([("old1", "1"), ("old2", "2")], "code string, corrected string")
    bounds = va.Boundaries({1: str(tmp_path / "rings")})
    got = va.run_consistency(spark, product, bounds, str(tmp_path / "truth.csv"), {"zone_id": "code", "truth": "total"}, "province", str(tmp_path / "report"), "p", codes, faults=True)
    report = {r.measure: r.value for r in got.collect()}
    assert report.pop("unreadable_amounts") == 1.0
    assert (report["n"], report["bias"], report["zones_without_truth"], report["truth_without_zone"]) == (2.0, 0.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        bounds.for_task(spark, "country")
    with pytest.raises(ValueError):
        va.Product(str(tmp_path / "meta.json")).read(spark)
    assert tr.correct_codes(spark.createDataFrame([("t", "old1", 1.0)], "task string, zone_id string, truth double"), codes).first().zone_id == "1"


def test_reports_from_cells_by_row(spark, tmp_path, edges, monkeypatch):  # noqa: F811
    laid = zn.write_cells_by_row(grid_cells(spark, MIXED), "cells_for_report", str(tmp_path / "laid"), 3)
    want = sorted(map(str, va.zone_totals(grid_cells(spark, MIXED), edges, W, H, "t", -9999.0).select("zone_id", "cells", "valid", "min", "max").collect()))
    monkeypatch.setattr(zn, "SMALL_SPANS", 1)
    found = va.zone_totals(zn.RowCells(laid), edges, W, H, "t", -9999.0).select("zone_id", "cells", "valid", "min", "max")
    assert sorted(map(str, found.collect())) == want
    spark.sql("DROP TABLE cells_for_report")


def test_malformed_metadata_and_amounts(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"dataset_name": "x", "width": "wide"}')
    with pytest.raises(ValueError, match="malformed"):
        gr.grid_of_product(so.read_product_metadata(spark, str(tmp_path / "bad.json")))


def test_empty_and_missing(spark, edges):  # noqa: F811
    none = grid_cells(spark).limit(0)
    spans = zn.row_spans(edges, W, H)
    tiles = ti.Tiles(spark.createDataFrame([], "tile_row int, tile_col int, values array<float>"), 5, 4)
    assert zo.zonal_stats_of_tiles(tiles, spans).count() == 0 and ti.block_aggregate_any(tiles, 3).count() == 0
    assert zo.zonal_stats_of_tiles(ti.Tiles(so.cells_to_tiles(grid_cells(spark), 5, 4), 5, 4), spans.limit(0)).count() == 0
    words, seen = ce.examined(none, lambda df: df.checkpoint())
    assert seen["cells"] == 0 and ce.completeness(words, W, H).first().missing_cells == W * H
    assert zn.overlap_runs(spans.limit(0)).count() == 0 and zo.exact_zonal_stats(zn.assign_zones(none, zn.in_bins(spans))).count() == 0


def test_workers_get_few_tiles_at_a_time(spark):
    """Tiles of 32 kilobytes come to a worker by a few hundred, not by as many as a partition has."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        cells = spark.range(600).selectExpr("cast(id * 64 as int) AS row", "0 AS col", "cast(id AS double) AS value")
        tiles = so.cells_to_tiles(cells, 64, 64).coalesce(1)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        got = [r.n for r in tiles.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 600 and max(got) <= 300
        blocks = ce.block_aggregate_tiles(tiles, 64, 64, 32)
        assert blocks.count() == 2400 and blocks.agg({"value": "sum"}).first()[0] == 600 * 599 / 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_missing_cells_of_narrow_grids_need_few_words(spark):
    """Bitmaps run on from row to row: 64,000 rows of seven columns are 7,000 words, not one a row."""
    cells = spark.range(64_000).selectExpr("cast(id as int) AS row", "cast(id % 7 as int) AS col")
    gone = ce.missing_cells(cells, 7, 64_000)
    assert gone.count() == 6 * 64_000 and gone.filter("col = row % 7").count() == 0 and gone.distinct().count() == 6 * 64_000
    assert ce.missing_cells(cells, 7, 63_999).count() == 6 * 63_999 and ce.missing_cells(cells, 0, 5).count() == ce.missing_cells(cells, 7, 0).count() == 0
    assert "Range (0, 7000," in gone._jdf.queryExecution().optimizedPlan().toString()
