"""Structural yearly peaks of metered series, as Spark DataFrame plans."""

from structpeak.config import RESULT_KEY, SERIES_KEY, PeakConfig

__all__ = ["RESULT_KEY", "SERIES_KEY", "PeakConfig"]
