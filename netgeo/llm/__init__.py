"""Operators of a training-data pipeline; see ``queries`` for their registration."""
