"""The driver contract, and a sample of registered queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SAMPLE = ["feed_page", "feed_facet_filters", "dashboard_top_lists", "evidence_counters", "url_keys", "relevance_bulletins", "extraction", "dedup_exact_keys",
          "dedup_first_wins", "link_best_match", "versions_material_changes", "alert_messages", "user_export", "query_percolation", "query_percolation_all", "query_candidates", "incident_detail", "incident_narrative",
          "dedup_similar_headlines", "source_tier_by_host", "text_similarity", "store_upsert_articles", "store_children", "stream_daily_counts"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    rel = con.sql(entry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
