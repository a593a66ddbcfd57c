"""Audit operators over response and attempt logs.

All are column expressions or one grouped aggregation, so they run where the
data lives; the only shuffle (A8) pre-aggregates per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.redact import redact
from recordlake.functions.text import py_strip_column, shorten

# Response classes, the error each one raises and its exit code.
ERROR_TYPE = {
    "blocked": "UpstreamBlockedError",
    "rate_limited": "RateLimitedError",
    "temporary": "UpstreamSchemaOrTemporaryError",
}
EXIT_CODE = {"ok": 0, "passed": 0, "blocked": 20, "rate_limited": 21, "temporary": 30}
#: Error type -> exit code (Q11) of collection and ingest; any other error is an internal failure.
ERROR_EXIT_CODE = {
    "UsageError": 2, "InputPathError": 2, "CredentialRequiredError": 10, "UpstreamBlockedError": 20, "RateLimitedError": 21,
    "UpstreamSchemaOrTemporaryError": 30, "CollectorError": 30, "RecordValidationError": 30, "ValidationError": 30,
    "InternalFailureError": 40,
}
INTERNAL_FAILURE = 40
# Retry caps per class and backoff windows (seconds).
RETRY_CAP = {"blocked": 1, "rate_limited": 2, "temporary": 3}
RATE_LIMIT_BACKOFF = (120.0, 300.0)
TEMPORARY_BASE = 30.0
TEMPORARY_JITTER = (0.8, 1.2)


def _map(d: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in reversed(list(d.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def classify_response(status: Column | str, body: Column | str) -> Column:
    """Q4: 2xx ok (body not scanned); 401/403 or 'access denied'/'forbidden' → blocked;
    429 or 'rate limit'/'throttle' → rate_limited; ≥500 → temporary; else passed."""
    s = F.col(status) if isinstance(status, str) else status
    b = F.lower(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")))
    return (
        F.when((s >= 200) & (s < 300), "ok")
        .when(s.isin(401, 403) | b.contains("access denied") | b.contains("forbidden"), "blocked")
        .when((s == 429) | b.contains("rate limit") | b.contains("throttle"), "rate_limited")
        .when(s >= 500, "temporary")
        .otherwise("passed")
    )


def exit_code(error_type: Column | str) -> Column:
    """Q11: the process exit code of an error type; 0 without an error."""
    e = F.col(error_type) if isinstance(error_type, str) else error_type
    return F.when(e.isNull(), F.lit(0)).otherwise(F.coalesce(_map(ERROR_EXIT_CODE, e), F.lit(INTERNAL_FAILURE))).cast("int")


def exit_code_of(error: BaseException | None) -> int:
    """Driver-side twin of ``exit_code``: the nearest class of the error that has a code."""
    if error is None:
        return 0
    return next((ERROR_EXIT_CODE[c.__name__] for c in type(error).__mro__ if c.__name__ in ERROR_EXIT_CODE), INTERNAL_FAILURE)


def response_classes(log: DataFrame) -> DataFrame:
    """Q4 + Q11 over a response log with ``status`` and ``body``."""
    cls = classify_response("status", "body")
    return log.withColumn("response_class", cls).withColumn(
        "error_type", _map(ERROR_TYPE, F.col("response_class"))
    ).withColumn("exit_code", _map(EXIT_CODE, F.col("response_class")).cast("int"))


def retry_verdict(attempts: DataFrame) -> DataFrame:
    """Q5 per attempt (``response_class``, ``attempt_no``): the policy's decision.

    ``retry`` — the loop tries again; ``exhausted`` — it gives up on this class;
    backoff bounds of the sleep before the next try (NULL when none).
    """
    cls, n = F.col("response_class"), F.col("attempt_no")
    cap = _map(RETRY_CAP, cls).cast("int")
    retry = cap.isNotNull() & (n < cap)
    base = F.lit(TEMPORARY_BASE) * F.pow(F.lit(2.0), n - 1)
    lo = F.when(retry & (cls == "rate_limited"), F.lit(RATE_LIMIT_BACKOFF[0])).when(
        retry & (cls == "temporary"), base * TEMPORARY_JITTER[0])
    hi = F.when(retry & (cls == "rate_limited"), F.lit(RATE_LIMIT_BACKOFF[1])).when(
        retry & (cls == "temporary"), base * TEMPORARY_JITTER[1])
    return attempts.select(
        "*", cap.alias("retry_cap"), retry.alias("retry"),
        (cap.isNotNull() & (n >= cap)).alias("exhausted"),
        lo.alias("backoff_min_s"), hi.alias("backoff_max_s"),
    )


def _ends(cls: Column, n: Column) -> Column:
    """An attempt ends the retry loop: success, non-retryable, or its class cap reached."""
    cap = _map(RETRY_CAP, cls).cast("int")
    return cap.isNull() | (n >= cap)


def attempt_rollup(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per (run, query) — attempts logged, the attempt that ended the loop and
    its outcome (``success`` or the failing class); ``pending`` when none ended."""
    cls, n = F.col("response_class"), F.col("attempt_no")
    end_n = F.when(_ends(cls, n), n)
    order = F.struct(n, F.col("event_id"))
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts_logged"),
        F.max(n).alias("max_attempt_no"),
        F.min(end_n).alias("ending_attempt"),
        F.min_by(cls, F.when(_ends(cls, n), order)).alias("_end_cls"),
        F.max_by(cls, order).alias("last_class"),
    ).select(
        *keys, "attempts_logged", "max_attempt_no", "ending_attempt",
        F.when(F.col("_end_cls").isNull(), "pending")
        .when(F.col("_end_cls").isin("ok", "passed"), "success")
        .otherwise(F.col("_end_cls")).alias("outcome"),
        "last_class",
    )


def redacted_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Q9/X16 over whole texts: changed flag, digest of the redacted text, short diagnostic."""
    staged = docs.select(key, text, redact(text).alias("_r"))
    staged = staged.select(key, text, "_r", py_strip_column("_r").alias("_s"))
    r = F.col("_r")
    return staged.select(
        key,
        (r != F.col(text)).alias("changed"),
        F.sha2(r, 256).alias("redacted_sha256"),
        shorten("_s").alias("short_message"),
    )
