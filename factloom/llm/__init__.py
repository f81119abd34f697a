"""Operators for training-data pipelines, their named queries and oracle SQL.

Nothing else in the library imports this package.
"""

from .catalog import ORACLES, QUERIES  # noqa: F401
