"""Hierarchical demand analytics on Spark."""
