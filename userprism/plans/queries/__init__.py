"""All named queries: importing the modules registers them."""

from . import assembly, cleaning, grouped, idsets, layout, models, properties, reports, scores, states, wide
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "assembly", "cleaning", "grouped", "idsets", "layout", "models", "properties",
    "reports", "scores", "states", "wide",
]
