"""Semantic analytics on Spark: a declared model of datasets and metrics, answered by Catalyst."""
