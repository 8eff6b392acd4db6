"""Queries over the test tables, each with the SQL that states its expected result where SQL can."""

from catalog import aggregates, cleaning, evaluation, retrieval, sources, text  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
