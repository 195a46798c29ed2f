"""Operator compositions: preparation, evaluation and search over many runs."""
