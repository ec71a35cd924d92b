"""Imports every catalog module, which registers its queries."""

from foreshock.catalog import data_signal, forecast, label_matrix, models, ranking, stored, streams, window_features  # noqa: F401
from foreshock.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
