"""News metadata: hashes instead of headlines, first-seen availability, sorted entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKFILL_DAYS = 1


def normalise(articles: DataFrame, first_seen: Column, source: str = "alpaca") -> DataFrame:
    """``articles(id, headline, created_at, updated_at, author, source, url, symbols)`` to news events."""
    published = F.col("created_at")
    backfill = published < F.timestamp_add("DAY", F.lit(-BACKFILL_DAYS), first_seen)
    flags = F.struct(
        F.col("author").alias("author"), backfill.alias("historical_backfill"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"),
    )
    return articles.select(
        F.concat(F.lit(f"{source}:"), F.col("id").cast("string")).alias("event_id"),
        published.alias("published_at"), first_seen.alias("first_seen_at"),
        F.greatest(published, first_seen).alias("available_at"),
        F.concat(F.lit(f"{source}-news:"), "source").alias("source"),
        F.sha2("headline", 256).alias("title_hash"), F.col("url").alias("raw_uri"),
        F.to_json(F.array_sort("symbols")).alias("entity_ids"),
        F.to_json(flags, {"ignoreNullFields": "false"}).alias("quality_flags"),
    )
