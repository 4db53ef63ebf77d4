"""Larkspan: coverage verification and training-data preparation as Spark plans."""
