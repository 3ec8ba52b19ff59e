"""Vessel cross-reference analytics on Spark."""
