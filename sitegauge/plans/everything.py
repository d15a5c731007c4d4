"""Importing this module registers every query."""

from . import (  # noqa: F401
    audit_queries,
    element_queries,
    evaluation_queries,
    html_queries,
    insight_queries,
    output_queries,
    page_queries,
    quality_queries,
    step_queries,
    text_queries,
)
from .catalog import ORACLES, QUERIES  # noqa: F401
