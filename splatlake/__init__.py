"""Spark-native analysis of 3D Gaussian-splat scenes, and (in ``llm``) training-data operators."""
