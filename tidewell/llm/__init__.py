"""Operators of a training-data pipeline. Nothing else in tidewell imports this subpackage."""
