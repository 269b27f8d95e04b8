"""File streams with declared schemas. A message bus reader yields the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlake.sources.payloads import dlq_split, parse_wa_events

FILES_PER_BATCH = 20


def read_stream(spark: SparkSession, path: str, ddl: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """Parquet files as they land; the checkpoint of the query is the acknowledgement."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path)


def read_results(spark: SparkSession, path: str, files: int = FILES_PER_BATCH) -> tuple[DataFrame, DataFrame]:
    """Enrichment results (raw_id, body): usable rows and the dead letters."""
    return dlq_split(read_stream(spark, path, "raw_id bigint, body string", files))


def read_wa_events(spark: SparkSession, path: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """Messaging webhook events (event_id, ts, body) as flat rows."""
    raw = read_stream(spark, path, "event_id bigint, ts timestamp_ntz, body string", files)
    return parse_wa_events(raw)

