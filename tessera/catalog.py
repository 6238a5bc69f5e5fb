"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import corpus, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **corpus.QUERIES}
ORACLE: dict[str, str] = {**retrieval.ORACLE, **corpus.ORACLE}
