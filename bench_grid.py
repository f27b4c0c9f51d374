"""Times raster operators on a made-up raster of real size; prints one JSON line. BENCH_GRID (width x height, default
8640x6016), BENCH_CPUS and BENCH_DIR (a shared folder with room for some 20 bytes a pixel) choose what runs where.
"""

import json
import math
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.operators import cells as ce
from rastermill.operators import tiles as ti
from rastermill.operators import zonal as zo
from rastermill.operators import zones as zn
from rastermill.sources import products as so
from rastermill.sources.shared import settle

TILE, NODATA = 512, -9999.0


def made_tiles(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Tiles of a smooth raster with no-data patches."""
    across, down = -(-width // TILE), -(-height // TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                y, x = np.mgrid[k // across * TILE : k // across * TILE + TILE, k % across * TILE : k % across * TILE + TILE]
                value = np.where((x // 37 + y // 41) % 5 == 0, NODATA, np.abs(np.sin(x / 91) * np.cos(y / 77)) * 1000).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k // across], pa.int32()), pa.array([k % across], pa.int32()), pa.array([value.ravel()], pa.list_(pa.float32()))], names=["tile_row", "tile_col", "values"])

    return spark.range(across * down).repartition(64).mapInArrow(run, "tile_row int, tile_col int, values array<float>")


def made_rings(spark: SparkSession, width: int, height: int, n: int = 15, points: int = 400) -> DataFrame:
    """n x n zones with many-cornered borders; each overlaps its neighbours a little."""
    rows = []
    for i in range(n * n):
        cx, cy = (i % n + 0.5) * 2 * width / n, (i // n + 0.5) * 2 * height / n
        ring = [(cx + math.cos(t) * width / n * (1.02 + 0.06 * math.sin(9 * t)), cy + math.sin(t) * height / n * (1.02 + 0.06 * math.cos(7 * t))) for t in np.linspace(0, 2 * math.pi, points, endpoint=False)]
        rows.append((f"z{i}", f"p{i % n}", [(float(x), float(y)) for x, y in ring]))
    return spark.createDataFrame(rows, so.RINGS)


def main() -> None:
    width, height = map(int, os.environ.get("BENCH_GRID", "8640x6016").split("x"))
    cpus, base = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_DIR") or tempfile.mkdtemp(prefix="spark-")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g", "spark.checkpoint.dir": f"{base}/checkpoints", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.sql.execution.arrow.maxRecordsPerBatch": "200000"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, df: DataFrame) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 2)

    made_tiles(spark, width, height).write.parquet(f"{base}/tiles")
    tiles = ti.Tiles(spark.read.parquet(f"{base}/tiles"), TILE, TILE)
    so.tiles_to_cells(tiles.frame, TILE, TILE, width, height).write.parquet(f"{base}/cells")
    cells = spark.read.parquet(f"{base}/cells")
    edges = so.ring_edges(made_rings(spark, width, height))
    began = time.perf_counter()
    spans = settle(zn.row_spans(edges, width, height))
    count = spans.count()
    took["row_spans"] = round(time.perf_counter() - began, 2)
    timed("totals_from_tiles", zo.zonal_stats_of_tiles(tiles, spans, NODATA, count=count))
    timed("totals_from_unpacked_tiles", zo.zonal_stats(zn.assign_zones(ce.mask_nodata(so.tiles_to_cells(tiles.frame, TILE, TILE, width, height), NODATA), zn.in_bins(spans), count=count)))
    timed("totals_from_cells", zo.zonal_stats(zn.assign_zones(ce.mask_nodata(cells, NODATA), zn.in_bins(spans), count=count)))
    timed("overlaps_from_spans", zn.overlap_by_zone(spans, zn.overlap_runs(spans)))
    timed("blocks_of_7_from_tiles", ti.block_aggregate_any(tiles, 7, NODATA, width, height))
    timed("blocks_of_2_from_tiles", ti.block_aggregate_any(tiles, 2, NODATA, width, height))
    timed("blocks_of_2_from_cells", ce.block_aggregate(ce.mask_nodata(cells, NODATA), 2))
    began = time.perf_counter()
    words, seen = ce.examined(ce.mask_nodata(cells, NODATA), settle)
    whole = ce.completeness(words, width, height).first()
    took["shape_summary_and_completeness"] = round(time.perf_counter() - began, 2)
    if "BENCH_BY_ROW" in os.environ:
        began = time.perf_counter()
        laid = zn.write_cells_by_row(ce.mask_nodata(cells, NODATA), "bench_cells", f"{base}/by_row", 64)
        took["lay_cells_out_by_row"] = round(time.perf_counter() - began, 2)
        timed("totals_in_place_by_row", zo.zonal_stats(zn.assign_zones_by_row(laid, spans)))
    print(json.dumps({"pixels": width * height, "cells": seen["cells"], "missing": whole.missing_cells, "repeats": whole.repeats, "spans": count, "cpus": int(cpus), "seconds": took}))


if __name__ == "__main__":
    main()
