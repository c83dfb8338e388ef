"""All registered queries and their SQL."""

from __future__ import annotations

from . import page_queries, prompt_queries, retrieval_queries, settings_queries, source_queries, stream_queries, tenant_queries, text_queries, usage_queries

_MODULES = (text_queries, retrieval_queries, usage_queries, page_queries, stream_queries, settings_queries, prompt_queries, tenant_queries, source_queries)
_ALL = {name: q for m in _MODULES for name, q in m.QUERIES.items()}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
