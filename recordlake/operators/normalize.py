"""Response envelopes → normalised records.

A response is one JSON document holding a list of results at a fixed path.
Everything here is evaluated per response row with higher-order functions
over the results array (``transform`` / ``filter`` / ``exists``), so deciding
that one bad result rejects its whole response needs no shuffle; only the
final ``posexplode`` turns accepted responses into one row per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import jsonx as J
from recordlake.functions.text import blank_to_null, py_strip
from recordlake.schemas import DEFAULT_SOURCE, DEFAULT_URL_PREFIX, RECORD_FIELDS

# Where the upstream search response keeps its result list.
RESULTS_PATH = "$.data.search.universalSearchNuxt.visitorJobSearchV1.results"

# Error texts of the upstream contract.
ERR_INVALID_JSON = "fixture must contain valid JSON"
ERR_NOT_OBJECT = "fixture must contain a JSON object"
ERR_ERRORS = "upstream GraphQL returned errors"
ERR_PATH = "upstream response missing job results path"
ERR_NOT_LIST = "upstream job results path is not a list"
ERR_ITEM = "upstream job result item is not an object"
ERR_NO_ID = "job result missing required raw identity field"
ERR_NO_CIPHER = "job result missing required ciphertext for permalink"
ERR_NO_TEXT = "job result missing title or description"
ERR_ZERO = "live collection returned zero jobs"

# Python float() syntax (ASCII digits): sign, digits with single underscores,
# optional fraction and exponent, or inf / infinity / nan.
_PY_FLOAT = (
    r"(?i)^[+-]?(?:inf|infinity|nan|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)"
    r"(?:e[+-]?\d(?:_?\d)*)?)$"
)


def first_text(v: Column, *paths: str) -> Column:
    """First value that is a string with non-blank content, stripped."""
    return F.coalesce(*[blank_to_null(J.typed_str(v, p)) for p in paths])


def number(v: Column, path: str) -> Column:
    """JSON number → double; numeric text (Python float syntax) → double; else NULL."""
    s = py_strip(J.typed_str(v, path))
    parsed = F.when(s.rlike(_PY_FLOAT), F.regexp_replace(s, "_", "").try_cast("double"))
    return F.coalesce(J.typed_double(v, path), parsed)


def budget_amount(obj: Column, *keys: str) -> Column:
    """First numeric value among ``keys`` of an object."""
    return F.when(J.is_object(obj), F.coalesce(*[number(obj, f"$.{k}") for k in keys]))


def _job(r: Column) -> Column:
    """``job`` if an object, else ``jobTile.job`` if an object, else absent."""
    tile = F.when(J.is_object(r, "$.jobTile") & J.is_object(r, "$.jobTile.job"), J.node(r, "$.jobTile.job"))
    return F.when(J.is_object(r, "$.job"), J.node(r, "$.job")).otherwise(tile)


def skills_of(raw: Column) -> Column:
    """List items → names; strings stripped, objects by name/prettyName/skill/prefLabel."""
    arr = F.when(J.is_array(raw), F.try_variant_get(raw, "$", "array<variant>"))
    names = F.transform(
        arr,
        lambda e: F.when(J.is_string(e), blank_to_null(J.typed_str(e))).when(
            J.is_object(e), first_text(e, "$.name", "$.prettyName", "$.skill", "$.prefLabel")
        ),
    )
    return F.coalesce(F.filter(names, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def result_fields(r: Column, source: str = DEFAULT_SOURCE, url_prefix: str = DEFAULT_URL_PREFIX,
                  job: Column | None = None) -> dict[str, Column]:
    """N5–N11 for one result object: the record fields plus ``error``.

    ``job`` may be passed as an already computed column (see ``records``) so the
    job-object resolution is evaluated once per row rather than in every field.
    """
    job = _job(r) if job is None else job
    raw_id = F.coalesce(first_text(r, "$.id", "$.uid"), first_text(job, "$.id"))
    cipher = F.coalesce(first_text(r, "$.cipherText", "$.ciphertext"), first_text(job, "$.cipherText", "$.ciphertext"))
    decimal = F.coalesce(raw_id.rlike(r"^\p{Nd}+$"), F.lit(False))
    job_id = F.when(cipher.isNotNull(), cipher).when(decimal, F.concat(F.lit("~02"), raw_id))
    title = F.coalesce(first_text(r, "$.title"), first_text(job, "$.title"))
    description = F.coalesce(first_text(r, "$.description", "$.snippet"), first_text(job, "$.description"))
    error = (
        F.when(raw_id.isNull(), F.lit(ERR_NO_ID))
        .when(job_id.isNull(), F.lit(ERR_NO_CIPHER))
        .when(title.isNull() | description.isNull(), F.lit(ERR_NO_TEXT))
    )
    skills_src = F.coalesce(J.node(r, "$.skills"), J.node(job, "$.skills"), J.node(r, "$.ontologySkills"))
    hourly = F.coalesce(J.node(r, "$.hourlyBudget"), J.node(job, "$.hourlyBudget"))
    synth = hourly.isNull() & (J.node(job, "$.hourlyBudgetMin").isNotNull() | J.node(job, "$.hourlyBudgetMax").isNotNull())
    fixed = F.coalesce(
        J.node(r, "$.fixedPriceBudget"), J.node(job, "$.fixedPriceBudget"),
        F.when(J.is_object(job, "$.fixedPriceAmount"), J.node(job, "$.fixedPriceAmount")),
    )
    return {
        "error": error,
        "source": F.lit(source),
        "id": job_id,
        "title": title,
        "description": description,
        "url": F.concat(F.lit(url_prefix), job_id),
        "skills": skills_of(skills_src),
        "posted_at": F.coalesce(first_text(r, "$.postedOn", "$.posted_at"), first_text(job, "$.postedOn", "$.publishTime")),
        "job_type": F.coalesce(first_text(r, "$.jobType", "$.job_type"), first_text(job, "$.jobType")),
        "contractor_tier": F.coalesce(first_text(r, "$.contractorTier", "$.contractor_tier"), first_text(job, "$.contractorTier")),
        "hourly_min": F.when(synth, number(job, "$.hourlyBudgetMin")).otherwise(budget_amount(hourly, "min", "hourly_min")),
        "hourly_max": F.when(synth, number(job, "$.hourlyBudgetMax")).otherwise(budget_amount(hourly, "max", "hourly_max")),
        "fixed_amount": budget_amount(fixed, "amount", "fixed_amount"),
        "raw_id": raw_id,
    }


def _truthy(e: Column) -> Column:
    """Python truthiness of a JSON value (NULL/absent is false)."""
    t = F.schema_of_variant(e)
    return F.coalesce(
        F.when(e.isNull(), F.lit(False))
        .when(t.startswith("ARRAY"), F.size(F.try_variant_get(e, "$", "array<variant>")) > 0)
        .when(t.startswith("OBJECT"), t != "OBJECT<>")
        .when(t == "STRING", F.try_variant_get(e, "$", "string") != "")
        .when(t == "BOOLEAN", F.try_variant_get(e, "$", "boolean"))
        .otherwise(F.try_variant_get(e, "$", "double") != 0),
        F.lit(False),
    )


def audit(responses: DataFrame, body: str = "body", path: str = RESULTS_PATH) -> DataFrame:
    """Classify each response; adds ``audit_class``, ``audit_error`` and ``_results``.

    The parse and the result-list lookup are computed once per response; the
    verdict is generator output so later filters cannot copy the parse.
    """
    base = list(responses.columns)
    staged = responses.select(*base, J.parse(py_strip(F.col(body))).alias("_v"))
    staged = staged.select(*base, "_v", F.try_variant_get(F.col("_v"), path, "variant").alias("_res"))
    v, res = F.col("_v"), F.col("_res")
    arr = F.when(J.is_array(res), F.try_variant_get(res, "$", "array<variant>"))
    bad_item = F.exists(arr, lambda e: ~J.is_object(e))
    cls = (
        F.when(v.isNull(), "invalid_json")
        .when(~J.is_object(v), "not_object")
        .when(_truthy(J.node(v, "$.errors")), "errors_present")
        .when(res.isNull(), "path_missing")
        .when(arr.isNull(), "not_list")
        .when(bad_item, "item_not_object")
        .otherwise("ok")
    )
    msg = {
        "invalid_json": ERR_INVALID_JSON, "not_object": ERR_NOT_OBJECT, "errors_present": ERR_ERRORS,
        "path_missing": ERR_PATH, "not_list": ERR_NOT_LIST, "item_not_object": ERR_ITEM,
    }
    out = J.evaluate_once(staged, base, {"audit_class": cls, "_arr": arr})
    err = F.lit(None).cast("string")
    for k, m in reversed(list(msg.items())):
        err = F.when(F.col("audit_class") == k, F.lit(m)).otherwise(err)
    return out.select(*base, "audit_class", err.alias("audit_error"),
                      F.when(F.col("audit_class") == "ok", F.col("_arr")).alias("_results"))


def normalize(responses: DataFrame, body: str = "body", source: str = DEFAULT_SOURCE,
              url_prefix: str = DEFAULT_URL_PREFIX) -> DataFrame:
    """Per response, ``status`` ok/rejected and ``error`` (first failure: the
    envelope's, else the first failing result's), plus ``_results``."""
    a = audit(responses, body)
    first_bad = F.try_element_at(
        F.filter(F.transform(F.col("_results"), lambda r: result_fields(r, source, url_prefix)["error"]),
                 lambda e: e.isNotNull()),
        F.lit(1),
    )
    err = F.coalesce(F.col("audit_error"), first_bad)
    keep = [c for c in a.columns]
    out = J.evaluate_once(a, keep, {"error": err})
    return out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("rejected"))


def records(normalized: DataFrame, keys: list[str], source: str = DEFAULT_SOURCE,
            url_prefix: str = DEFAULT_URL_PREFIX) -> DataFrame:
    """Accepted responses → one normalised record per result, with ``pos`` (0-based)."""
    ok = normalized.where(F.col("status") == "ok").select(*keys, F.posexplode("_results").alias("pos", "_r"))
    staged = ok.select(*keys, "pos", "_r", _job(F.col("_r")).alias("_job"))
    f = result_fields(F.col("_r"), source, url_prefix, job=F.col("_job"))
    return staged.select(*keys, "pos", *[f[k].alias(k) for k in f if k != "error"])


def rejects(normalized: DataFrame, keys: list[str]) -> DataFrame:
    return normalized.where(F.col("status") == "rejected").select(*keys, "audit_class", "error")


def jsonl_value() -> Column:
    """One compact JSON object per record, record field order, nulls kept."""
    return F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"})
