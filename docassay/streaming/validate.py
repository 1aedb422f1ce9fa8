"""Validation of a stream of scans: a stateless map behind a stream-static join."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docassay.plans.validate import validate


def validate_stream(scans: DataFrame, registry: DataFrame, type_name: str, as_of: datetime.date, path: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of every scan that arrives, appended to Parquet exactly once. The registry's keys must be unique."""
    verdicts = validate(scans, registry, type_name, as_of, unique_registry=True)
    return verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
