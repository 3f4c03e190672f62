"""Operators for training-data pipelines: joins, scans, models and packing over whole corpora."""
