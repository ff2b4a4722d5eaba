"""Queries over the driver's tables, one or more for each group of operators, and DuckDB SQL where SQL can say the same."""

from . import core, formats, models
from .base import QUERIES, SQL
from .models import TWO, observations

__all__ = ["QUERIES", "SQL", "TWO", "core", "formats", "models", "observations"]
