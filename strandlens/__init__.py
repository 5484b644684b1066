"""Repertoire analytics on Spark: DataFrame-to-DataFrame operators over large sequence tables."""
