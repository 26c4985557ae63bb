"""Tables of a data directory, and their projection onto records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The columns of a collected record.
RAW = "source_key string, external_id string, url string, published_at timestamp, collected_at timestamp, text string, metadata string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(documents: DataFrame) -> DataFrame:
    """Documents as collected records: source_key, external_id, collected_at, published_at, text."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    published = F.when(F.col("doc_id") % 10 != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 - (F.col("doc_id") % 40) * 86400))
    return documents.select(F.col("source").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"), at.alias("collected_at"), published.alias("published_at"), "text")


def valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): records need a source, an id and a time of collection."""
    ok = F.coalesce((F.col("source_key") != "") & (F.col("external_id") != "") & F.col("collected_at").isNotNull(), F.lit(False))
    return items.where(ok), items.where(~ok)
