"""Spark-native k-way graph partitioning: sources, metrics, refinement, relabelling, contraction."""
