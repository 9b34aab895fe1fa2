"""Operators of a large training-data pipeline: scoring, filtering, joining, mixing and
packing documents. Nothing else in the package imports this subpackage."""
