"""Registered queries of the telemetry operators, one for each entry of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tankwatch.plans import q_basic, q_events, q_jobs, q_models

QUERIES: dict = {**q_basic.QUERIES, **q_events.QUERIES, **q_models.QUERIES, **q_jobs.QUERIES}
SQL: dict = {**q_basic.SQL, **q_events.SQL, **q_models.SQL, **q_jobs.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["r1_event_summary"](spark, sf_dir)
