"""Operators of a training-data pipeline. Nothing else in recallbase imports this subpackage."""
