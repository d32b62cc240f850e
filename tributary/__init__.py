"""Catchment analytics on Spark: networks, land units, census tables."""
