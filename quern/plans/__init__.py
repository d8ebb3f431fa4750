"""See the modules of this package."""

from . import build_queries, calendar_queries, graph_queries, text_queries  # noqa: F401  they register themselves
