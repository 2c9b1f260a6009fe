"""Requests as a stream: only the latest of each key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_requests(stream: DataFrame, key: str, epoch: str, *values: str) -> DataFrame:
    """The request with the greatest epoch of each key so far; older ones that come late are ignored. For output modes update and complete."""
    return stream.groupBy(key).agg(F.max_by(F.struct(epoch, *values), F.col(epoch)).alias("request")).select(key, "request.*")
