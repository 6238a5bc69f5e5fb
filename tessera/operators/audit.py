"""Audit events of answered questions: hashes and counts, never an answer's or a chunk's text."""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
DEFAULT_PATH = "logs/audit"


def events(answered: DataFrame, raw: bool = False, at: Column | None = None) -> DataFrame:
    """One event per row of answered: question, top_k, document_type, retrieved (array of structs), gate_outcome, action,
    citations, n_grounded, n_ungrounded, answer; and, where there are such columns, rewrites, rewrite_status, intent.

    With raw, question, rewrites and intent are also kept as texts. Null fields are left out of JSON.
    """
    has = lambda c: c in answered.columns
    sha = lambda c: F.sha2(c, 256)
    cols = {
        "timestamp": at if at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        "query_sha256": sha(F.col("question")), "query_chars": F.length("question"), "top_k": F.col("top_k"), "document_type": F.col("document_type"), "retrieved": F.col("retrieved"),
        "gate_outcome": F.col("gate_outcome"), "action": F.col("action"), "verified_count": F.col("n_grounded"), "unverified_count": F.col("n_ungrounded"),
        "citation_locators": F.transform("citations", lambda c: c["raw"]), "answer_chars": F.length("answer"),
    }
    if has("git_sha"):
        cols["git_sha"] = F.col("git_sha")
    if has("generation_model"):
        cols["generation_model"] = F.col("generation_model")
    if has("rewrites"):
        cols |= {"rewrite_status": F.col("rewrite_status"), "rewrite_count": F.size("rewrites"), "rewrite_sha256s": F.transform("rewrites", sha)}
    if has("intent"):
        cols["intent_rewrite_sha256"] = sha(F.col("intent"))
    if raw:
        cols |= {"query_text": F.col("question")} | ({"rewrite_texts": F.col("rewrites")} if has("rewrites") else {}) | ({"intent_rewrite_text": F.col("intent")} if has("intent") else {})
    return answered.select(*[c.alias(n) for n, c in cols.items()])


def path(given: str | None = None) -> str:
    """Where events go: the given path, else AUDIT_LOG_PATH, else the default."""
    return given or os.environ.get("AUDIT_LOG_PATH") or DEFAULT_PATH


def keeps_texts() -> bool:
    """Whether questions are logged as texts too (AUDIT_LOG_RAW_QUERIES=1)."""
    return os.environ.get("AUDIT_LOG_RAW_QUERIES") == "1"


def append(told: DataFrame, path: str) -> bool:
    """Append events as JSON lines; a failure is a warning only."""
    try:
        told.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001  the audit log never fails a query
        log.warning("audit events were not written to %s: %s", path, e)
        return False
    return True
