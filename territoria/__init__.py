"""Territorial analytics on Spark: star schema, scores, quality reports and imports as DataFrame plans."""
