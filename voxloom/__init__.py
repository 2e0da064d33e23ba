"""Spark-native analytics for volumetric time series, plus training-data operators in ``voxloom.llm``."""
