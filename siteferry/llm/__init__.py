"""Operators of a training-data pipeline: texts, pages and vectors in, deduplicated, scored and packed rows out."""
