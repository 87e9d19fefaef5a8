"""Bitemporal property-graph analytics on PySpark."""
