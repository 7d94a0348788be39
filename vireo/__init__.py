"""Vireo: DataFrame-first analytics for media-frame search and its catalogue, logs and ingestion."""
