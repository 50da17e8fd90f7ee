"""Spark-first analysis of repeated volumetric measurements as tensors."""

__version__ = "0.1.0"
