"""Partitioning, metrics, refinement, relabelling, contraction, iteration and the record store."""
