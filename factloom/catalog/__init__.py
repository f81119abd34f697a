"""All named queries. Importing the area modules fills the registry."""

from . import battery, history, ingest, surface, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
