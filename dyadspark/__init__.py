"""Pairwise (dyadic) and panel data integration as PySpark DataFrame functions."""

from dyadspark.session import get_spark

__all__ = ["get_spark"]
