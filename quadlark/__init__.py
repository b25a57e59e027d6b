"""Spark-native analytics for hierarchical, quadtree-addressed tile datasets."""
