"""Sources and sinks: review readers, the lineitem-derived review fixture, writers."""

from review_insights.sources.fixture import (fixture_from_lineitem, ingest_review_fixture, review_fixture,
                                             review_raw_table)
from review_insights.sources.readers import (normalise_missing, read_reviews, read_reviews_csv,
                                             read_reviews_parquet, read_table)
from review_insights.sources.sinks import (require_columns, scored_export, select_available,
                                           suggestion_export, write_report, write_table)

__all__ = [
    "fixture_from_lineitem", "ingest_review_fixture", "review_fixture", "review_raw_table", "normalise_missing", "read_reviews",
    "read_reviews_csv", "read_reviews_parquet", "read_table", "require_columns",
    "scored_export", "select_available", "suggestion_export", "write_report", "write_table",
]
