"""Operators of a training-data pipeline; nothing else in tessera imports them."""
