"""Raster cells, administrative zones and agreement with truth, as Spark jobs."""
