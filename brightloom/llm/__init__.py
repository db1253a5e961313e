"""Operators for preparing training data: search, joins, scores, packing and output files."""
