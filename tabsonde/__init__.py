"""Spark-native automated table analysis."""

from .errors import AnalysisError, InputError
from .operators.frame import ROWS, Frame, Where

__all__ = ["ROWS", "AnalysisError", "Frame", "InputError", "Where"]
