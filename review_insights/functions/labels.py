"""Label expressions: rating-derived sentiment and model-label normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from review_insights import constants as K


def rating_to_sentiment(rating: Column) -> Column:
    """>= 4 positive, == 3 neutral, anything else (including 3.5) negative."""
    return (F.when(rating >= K.POSITIVE_MIN_RATING, F.lit(K.POSITIVE))
            .when(rating == K.NEUTRAL_RATING, F.lit(K.NEUTRAL))
            .otherwise(F.lit(K.NEGATIVE)))


def normalise_label(raw: Column) -> Column:
    """Model label -> positive/negative/neutral by substring of the lower-cased label."""
    low = F.lower(raw)
    return (F.when(low.contains("pos"), F.lit(K.POSITIVE))
            .when(low.contains("neg"), F.lit(K.NEGATIVE))
            .otherwise(F.lit(K.NEUTRAL)))
