"""All registered queries."""
from .registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
from . import (filters_q, text_q, score_q, lookup_q, resolve_q, rank_q, report_q, table_q, page_q, facet_q, search_q, stream_q, run_q, source_q)  # noqa: F401,E501
