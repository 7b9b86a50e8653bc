"""Readings out of stored service payloads, on the JVM side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geohour.sources.rest import PAYLOAD_FIELDS, PAYLOAD_ROOT, PAYLOAD_SCHEMA


def readings_from_payload(df: DataFrame, payload: str) -> DataFrame:
    """One row per record of a JSON payload; a payload without rows gives none."""
    parsed = df.select(F.from_json(payload, PAYLOAD_SCHEMA).alias("_p"))
    rows = parsed.select(F.explode(f"_p.{PAYLOAD_ROOT}.row").alias("_r"))
    return rows.select(*[F.col(f"_r.{f}").alias(n) for n, f in PAYLOAD_FIELDS.items()])
