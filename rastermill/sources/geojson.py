"""Boundaries from GeoJSON: features with polygons, as rings that keep their part and whether they are a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates differ in depth by kind of geometry, so they are read as text first.
_FEATURE = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
_RING = "array<array<double>>"
RINGS = "zone_id string, parent_id string, part int, hole boolean, ring array<struct<x: double, y: double>>"
#: Fewest positions of a ring, the first one repeated at the end.
LEAST = 4


def read_features(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """One row a feature, from files that are one FeatureCollection each, or with `by_line` hold one feature a line (which
    many tasks can read at once). Text that is no JSON is one feature of nulls.
    """
    if by_line:
        return spark.read.schema("type string, properties map<string, string>, geometry struct<type: string, coordinates: string>").json(path)
    whole = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", True).json(path)
    return whole.select(F.explode_outer("features").alias("f")).select("f.type", "f.properties", "f.geometry")


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _fault(zone: Column) -> Column:
    """What is wrong with a feature; null if nothing."""
    ring_ok = lambda r: (F.size(r) >= LEAST) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, lambda p: (F.size(p) >= 2) & F.coalesce((F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90), F.lit(False)))
    part_ok = lambda part: (F.size(part) > 0) & F.forall(part, lambda r: F.coalesce(ring_ok(r), F.lit(False)))
    return (
        F.when(~F.coalesce(F.col("type") == "Feature", F.lit(False)), "no feature").when(zone.isNull(), "no zone").when(F.col("geometry").isNull(), "no geometry")
        .when(~F.coalesce(F.col("geometry.type").isin("Polygon", "MultiPolygon"), F.lit(False)), "no polygon").when(F.col("parts").isNull() | (F.size("parts") == 0), "no coordinates")
        .when(~F.forall("parts", part_ok), "bad ring")
    )


def geojson_rings(features: DataFrame, zone: str, parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rings, faults). Rings are (zone_id, parent_id, part, hole, ring) in degrees, without the repeated last point: the
    first ring of a part is its outline, the others are holes. Faults are (fault, features), how many features were left
    out and why; a feature with one bad ring is left out whole, so that no zone comes out in part.

    `zone` and `parent` name properties. A zone may come as several features; parts are then numbered in each.
    """
    zone_id = F.col("properties").getItem(zone)
    parent_id = F.col("properties").getItem(parent) if parent else F.lit(None).cast("string")
    one = F.array(F.from_json("geometry.coordinates", f"array<{_RING}>"))
    parts = F.when(F.col("geometry.type") == "Polygon", F.filter(one, lambda p: p.isNotNull())).when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", f"array<array<{_RING}>>"))
    found = features.withColumn("parts", parts).withColumn("fault", _fault(zone_id))
    good = found.filter("fault IS NULL").select(zone_id.alias("zone_id"), parent_id.alias("parent_id"), F.posexplode("parts").alias("part", "rings"))
    rings = good.select("zone_id", "parent_id", "part", F.posexplode("rings").alias("k", "ring"))
    open_ = F.slice("ring", 1, F.size("ring") - 1)
    return rings.select("zone_id", "parent_id", "part", (F.col("k") > 0).alias("hole"), _points(open_).alias("ring")), found.filter("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("features"))


def read_geojson(spark: SparkSession, path: str, zone: str, parent: str | None = None, by_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """`geojson_rings` of files."""
    return geojson_rings(read_features(spark, path, by_line), zone, parent)
