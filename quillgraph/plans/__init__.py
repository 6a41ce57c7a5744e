"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from . import graphs, more, spans, tables, theories, trees  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
