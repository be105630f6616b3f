"""The engine's queries, by name."""

from . import characterization, inference, models, networks, nulls, prediction, preparation, subjects
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "characterization", "inference", "models", "networks", "nulls", "prediction", "preparation", "subjects"]
