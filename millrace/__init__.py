"""Spark-native data preparation, profiling and modelling operators."""

from millrace.session import get_session

__all__ = ["get_session"]
