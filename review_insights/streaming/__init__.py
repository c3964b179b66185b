"""Structured Streaming: row-wise review stages on file streams and windowed problem counts."""

from review_insights.streaming.reviews import (RAW_REVIEW_SCHEMA, classify_stream, problem_counts,
                                               read_review_stream, start)

__all__ = ["RAW_REVIEW_SCHEMA", "classify_stream", "problem_counts", "read_review_stream", "start"]
