"""Registered queries over the driver's tables: (spark, sf_dir) -> DataFrame, with their SQL."""
