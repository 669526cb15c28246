"""Spark-native signature analytics: sequence records to minimizer graphs, scored markers and data-quality operators."""

__version__ = "0.1.0"
