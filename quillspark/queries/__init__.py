"""The catalogue of named queries and their SQL."""

from . import evaluation, search, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
