"""All queries over the reference workload. Importing the modules registers them."""

from . import application_queries, extract_queries, filing_queries, form_queries, gate_queries, graph_queries, ladder_queries, layout_queries, line_queries, match_queries, package_queries, proposition_queries, report_queries, resolve_queries, severity_queries, statute_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
