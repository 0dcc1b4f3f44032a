"""All registered queries: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from workload import feed_queries, link_queries, scan_queries, text_queries

REGISTRY = {**feed_queries.QUERIES, **text_queries.QUERIES, **link_queries.QUERIES, **scan_queries.QUERIES}
