"""Every query of the library by name, with the SQL that says the same."""

from __future__ import annotations

from folioforge.plans import queries_aggregate, queries_browse, queries_files, queries_search, queries_streams, queries_text  # noqa: F401
from folioforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
