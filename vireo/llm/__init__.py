"""Operators for large-scale training-data pipelines (mixing, joins, dedup, scoring, archives)."""
