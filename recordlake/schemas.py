"""Record and table schemas, field lists and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# Record contract field lists and the private-field names.
REQUIRED_STRING_FIELDS = ("source", "id", "title", "description", "url")
OPTIONAL_STRING_FIELDS = ("posted_at", "job_type", "contractor_tier", "raw_id")
OPTIONAL_NUMBER_FIELDS = ("hourly_min", "hourly_max", "fixed_amount")
ALLOWED_FIELDS = (*REQUIRED_STRING_FIELDS, "skills", *OPTIONAL_STRING_FIELDS, *OPTIONAL_NUMBER_FIELDS)
PRIVATE_FIELD_NAMES = (
    "cookie",
    "cookies",
    "authorization",
    "session",
    "session_id",
    "token",
    "access_token",
    "proxy",
    "proxy_url",
    "graphql_response",
    "raw_graphql_response",
)

# Control vocabulary.
CONFIG_KEYS = ("interval_seconds", "queries", "max_pages", "page_size", "paused")
COMMAND_TYPES = ("run_once", "pause", "resume", "update_config")
COMMAND_STATUSES = ("queued", "running", "applied", "failed")
TERMINAL_STATUSES = ("applied", "failed")

DEFAULT_SOURCE = "feed"
DEFAULT_URL_PREFIX = "https://jobs.example/jobs/"
MAX_QUERY_LIMIT = 100

# Normalised record (13 fields) in record order.
RECORD_FIELDS = (
    "source", "id", "title", "description", "url", "skills", "posted_at", "job_type",
    "contractor_tier", "hourly_min", "hourly_max", "fixed_amount", "raw_id",
)

JOBS = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("contractor_tier", T.StringType()),
    T.StructField("hourly_min", T.DoubleType()),
    T.StructField("hourly_max", T.DoubleType()),
    T.StructField("fixed_amount", T.DoubleType()),
    T.StructField("raw_id", T.StringType()),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("first_seen_at", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])
JOB_COLUMNS = tuple(f.name for f in JOBS.fields)

# Append-only event ledgers; current state is folded on read.
RUN_EVENTS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("trigger", T.StringType()),
    T.StructField("query_count", T.LongType()),
    T.StructField("total_seen", T.LongType()),
    T.StructField("total_inserted", T.LongType()),
    T.StructField("total_skipped", T.LongType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("redacted_error", T.StringType()),
])

RUN_RESULTS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("query_ix", T.LongType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("attempts", T.LongType(), False),
    T.StructField("seen_count", T.LongType(), False),
    T.StructField("inserted_count", T.LongType(), False),
    T.StructField("skipped_count", T.LongType(), False),
    T.StructField("error_type", T.StringType()),
    T.StructField("redacted_error", T.StringType()),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType(), False),
])

COMMAND_EVENTS = T.StructType([
    T.StructField("command_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("command_type", T.StringType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("requested_by", T.StringType()),
    T.StructField("result_json", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("redacted_error", T.StringType()),
])

CONFIG_EVENTS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value_json", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("updated_by", T.StringType(), False),
])
