"""Named queries with parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame

from . import catalogue

QUERIES = {
    "business": lambda t, filter=None: catalogue.business_stats(t["reviews"], t["classifications"], filter),
    "city": lambda t, filter=None: catalogue.city_stats(t["reviews"], t["classifications"], filter),
    "ranking": lambda t, metric="avg_rating", top=10: catalogue.business_ranking(
        t["reviews"], t["classifications"], metric, top),
    "trends": lambda t, granularity="month", filter=None: catalogue.temporal_trends(
        t["reviews"], t["classifications"], granularity, filter),
    "issues": lambda t, filter=None, top=10: catalogue.top_issues(t["reviews"], t["review_categories"], filter, top),
    "winners": lambda t: catalogue.city_winners(t["reviews"]),
    "compare": lambda t, businesses: catalogue.compare_businesses(
        t["reviews"], t["classifications"], [b.strip() for b in businesses.split(",")]
        if isinstance(businesses, str) else businesses),
}


def run_query(tables: dict[str, DataFrame], name: str, **params) -> DataFrame:
    """Run a query of the catalogue by name over a dict of the stored tables."""
    if name not in QUERIES:
        raise ValueError(f"unknown query {name!r}, expected one of {sorted(QUERIES)}")
    return QUERIES[name](tables, **params)
