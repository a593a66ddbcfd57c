"""Record-contract validation of JSON lines.

Input: ``(line_no, line)``. Output adds ``status`` (``blank``, ``malformed``,
``invalid`` or ``valid``), ``reason`` (the contract message, NULL if valid),
``message`` (the line-numbered diagnostic) and the typed, canonical record
fields. Each line is stripped and parsed once; the checks form one CASE
chain of built-in expressions in the contract's order, so the first failing
check names the reason: object → private key → unknown keys → source → id,
title, description, url → skills → posted_at, job_type, contractor_tier →
hourly_min, hourly_max, fixed_amount → raw_id. The chain is evaluated once
per line as generator output, so filters on the verdict cannot copy it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import jsonx as J
from recordlake.functions.canonical import bind, canonical_json, json_float, json_string
from recordlake.functions.text import (
    blank_to_null,
    canonical_token,
    casefold_exact,
    py_strip,
    py_strip_column,
)
from recordlake.schemas import (
    ALLOWED_FIELDS,
    DEFAULT_SOURCE,
    OPTIONAL_NUMBER_FIELDS,
    OPTIONAL_STRING_FIELDS,
    PRIVATE_FIELD_NAMES,
    RECORD_FIELDS,
)


#: Fields that must be non-blank text.
REQUIRED = ("source", "id", "title", "description", "url")

# The record contract's diagnostics ({key}/{keys}/{source}/{line}/{reason} are filled in).
MSG_NOT_OBJECT = "JSONL line must contain a JSON object"
MSG_PRIVATE = "collector payload contains disallowed private field: "
MSG_UNKNOWN = "collector payload contains unsupported fields: "
MSG_MISSING = "record missing required collector field: {key}"
MSG_SOURCE = "collector field source must be '{source}'"
MSG_SKILLS_TYPE = "collector field must be list[string]: skills"
MSG_STRING = "collector field must be string or null: {key}"
MSG_NUMBER = "collector field must be numeric or null: {key}"
MSG_MALFORMED = "malformed JSONL at line "
MSG_INVALID = "invalid collector record at line {line}: {reason}"


class RecordValidationError(ValueError):
    """Fail-closed rejection of a batch; carries the first diagnostic."""


def _req(v: Column, key: str) -> Column:
    """A required text: stripped, NULL when it is blank or no string. Read from the VARIANT and stripped once."""
    return bind(J.typed_str(v, f"$.{key}"),
                lambda text: bind(py_strip_column(text), lambda stripped: F.when(stripped != "", stripped)))


def _skills_state(v: Column, exact_casefold: bool = False) -> tuple[Column, Column]:
    arr = J.variant_array(v, "$.skills")
    all_strings = F.forall(arr, lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
    folded = F.transform(arr, lambda e: canonical_token(F.try_variant_get(e, "$", "string"), exact_casefold))
    canon = F.array_distinct(F.filter(folded, lambda s: s != ""))
    return arr, F.when(all_strings, canon)


def canonical_payload(v: Column) -> Column:
    """The payload in typed form: the record's own fields, keys sorted, nulls kept, compact; one text per
    logical record, whichever fields its line leaves out and however it writes its numbers.

    Values are the payload's values before stripping; numbers are doubles.
    """
    fields = sorted(ALLOWED_FIELDS)
    parts = []
    for key in fields:
        if key in OPTIONAL_NUMBER_FIELDS:
            parts.append(J.typed_double(v, f"$.{key}").alias(key))
        elif key == "skills":
            arr = J.variant_array(v, "$.skills")
            parts.append(F.transform(arr, lambda e: F.try_variant_get(e, "$", "string")).alias(key))
        else:
            parts.append(J.typed_str(v, f"$.{key}").alias(key))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def diagnostic() -> Column:
    """Q2: the message of a rejected line, from its number, status and reason; null for the others."""
    line_no, status = F.col("line_no").cast("string"), F.col("status")
    return (F.when(status == "malformed", F.concat(F.lit(MSG_MALFORMED), line_no))
            .when(status == "invalid",
                  F.concat(F.lit(MSG_INVALID.split("{line}")[0]), line_no, F.lit(": "), F.col("reason"))))


def validate(lines: DataFrame, source: str = DEFAULT_SOURCE, exact_casefold: bool = False) -> DataFrame:
    """Classify every line and project the typed record of the valid ones.

    The stripped text, its parse, its key list, its required texts and its
    skills array are computed once per line; the verdict (status/reason/message) is produced as
    generator output so filters on it stay above the parse. Lines that have no
    ``line_no`` yet get no ``message``; ``diagnostic`` gives it once they are numbered.
    """
    base = list(lines.columns)
    t0 = lines.select(*base, py_strip_column("line").alias("_t"))
    t1 = t0.select(*base, "_t", J.parse(F.col("_t")).alias("_v"), J.object_keys_in_order(F.col("_t")).alias("_keys"))
    t2 = J.evaluate_once(t1, [*base, "_t", "_v", "_keys"], {f"_{k}": _req(F.col("_v"), k) for k in REQUIRED})
    text, v, keys = F.col("_t"), F.col("_v"), F.col("_keys")
    fold = casefold_exact if exact_casefold else F.lower
    private = F.try_element_at(F.filter(keys, lambda k: fold(py_strip(k)).isin(*PRIVATE_FIELD_NAMES)), F.lit(1))
    allowed = F.array(*[F.lit(k) for k in ALLOWED_FIELDS])
    unknown = F.array_join(F.array_sort(F.array_except(keys, allowed)), ", ")
    src = F.col("_source")
    skills_arr, skills = _skills_state(v)  # validity only needs the element types

    checks: list[tuple[Column, Column]] = [
        (~J.is_object(v), F.lit(MSG_NOT_OBJECT)),
        (private.isNotNull(), F.concat(F.lit(MSG_PRIVATE), private)),
        (unknown != "", F.concat(F.lit(MSG_UNKNOWN), unknown)),
        (src.isNull(), F.lit(MSG_MISSING.format(key="source"))),
        (src != F.lit(source), F.lit(MSG_SOURCE.format(source=source))),
    ]
    for key in ("id", "title", "description", "url"):
        checks.append((F.col(f"_{key}").isNull(), F.lit(MSG_MISSING.format(key=key))))
    checks.append((skills_arr.isNull(), F.lit(MSG_MISSING.format(key="skills"))))
    checks.append((skills.isNull(), F.lit(MSG_SKILLS_TYPE)))
    for key in OPTIONAL_STRING_FIELDS[:3]:
        bad = ~(J.is_null_or_absent(v, f"$.{key}") | J.is_string(v, f"$.{key}"))
        checks.append((bad, F.lit(MSG_STRING.format(key=key))))
    for key in OPTIONAL_NUMBER_FIELDS:
        bad = ~(J.is_null_or_absent(v, f"$.{key}") | J.is_number(v, f"$.{key}"))
        checks.append((bad, F.lit(MSG_NUMBER.format(key=key))))
    bad_raw = ~(J.is_null_or_absent(v, "$.raw_id") | J.is_string(v, "$.raw_id"))
    checks.append((bad_raw, F.lit(MSG_STRING.format(key="raw_id"))))

    reason = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        reason = F.when(cond, msg).otherwise(reason)

    # The contract check chain is evaluated once per line (generator output);
    # status and message are cheap projections of its result.
    required = [f"_{k}" for k in REQUIRED]
    verdict = J.evaluate_once(t2, [*base, "_v", *required], {
        "_blank": text == "",
        "_malformed": (text != "") & v.isNull(),
        "_reason": reason,
    })
    blank, malformed, why = F.col("_blank"), F.col("_malformed"), F.col("_reason")
    status = (
        F.when(blank, "blank").when(malformed, "malformed")
        .when(why.isNotNull(), "invalid").otherwise("valid")
    )
    verdict = verdict.select(*base, "_v", *required, status.alias("status"), F.when(~blank & ~malformed, why).alias("reason"))
    message = [diagnostic().alias("message")] if "line_no" in base else []
    vv = F.col("_v")
    valid = F.col("status") == "valid"
    record = [
        F.when(valid, F.col("_id")).alias("job_id"),
        F.when(valid, F.col("_source")).alias("source"),
        F.when(valid, F.col("_title")).alias("title"),
        F.when(valid, F.col("_description")).alias("description"),
        F.when(valid, F.col("_url")).alias("url"),
        F.when(valid, _skills_state(vv, exact_casefold)[1]).alias("skills"),
        *[F.when(valid, blank_to_null(J.typed_str(vv, f"$.{k}"))).alias(k) for k in OPTIONAL_STRING_FIELDS[:3]],
        *[F.when(valid, J.typed_double(vv, f"$.{k}")).alias(k) for k in OPTIONAL_NUMBER_FIELDS],
        F.when(valid, blank_to_null(J.typed_str(vv, "$.raw_id"))).alias("raw_id"),
        F.when(valid, canonical_json(vv, 2)).alias("payload_json"),
        F.when(valid, canonical_payload(vv)).alias("typed_json"),
    ]
    out = verdict.select(*base, "status", "reason", *message, *record)
    return out.withColumns({"content_hash": F.sha2(F.col("payload_json"), 256),
                            "typed_hash": F.sha2(F.col("typed_json"), 256)})


def record_json() -> Column:
    """V10 of a normalised record's columns: all 13 fields, keys sorted, as the record's JSON line would give it."""
    def value(name: str) -> Column:
        c = F.col(name)
        if name == "skills":
            text = F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ","), F.lit("]"))
        else:
            text = json_float(c) if name in OPTIONAL_NUMBER_FIELDS else json_string(c)
        return F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null")))

    return F.concat(F.lit("{"), F.concat_ws(",", *map(value, sorted(ALLOWED_FIELDS))), F.lit("}"))


def validate_records(records: DataFrame, source: str = DEFAULT_SOURCE, exact_casefold: bool = False) -> DataFrame:
    """The checks of ``validate`` on the 13 columns of normalised records (N13), which are typed already:
    required text, source and skills. Same columns out, so records go to ``ingest_checked`` without
    a JSON text in between. ``line_no`` is the number of the response."""
    keep = [c for c in records.columns if c not in RECORD_FIELDS]
    src = blank_to_null(F.col("source"))
    checks = [(src.isNull(), MSG_MISSING.format(key="source")), (src != F.lit(source), MSG_SOURCE.format(source=source))]
    checks += [(blank_to_null(F.col(k)).isNull(), MSG_MISSING.format(key=k)) for k in ("id", "title", "description", "url")]
    checks.append((F.col("skills").isNull(), MSG_MISSING.format(key="skills")))
    reason = F.lit(None).cast("string")
    for cond, text in reversed(checks):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    staged = records.select("*", reason.alias("reason"))
    valid = F.col("reason").isNull()
    skills = F.array_distinct(F.filter(F.transform("skills", lambda s: canonical_token(s, exact_casefold)), lambda s: s != ""))
    out = {"job_id": blank_to_null(F.col("id")), "skills": skills, "content_hash": F.sha2(record_json(), 256)}
    out |= {k: blank_to_null(F.col(k)) for k in ("source", "title", "description", "url", *OPTIONAL_STRING_FIELDS)}
    out |= {k: F.col(k) for k in OPTIONAL_NUMBER_FIELDS}
    message = F.concat(F.lit(MSG_INVALID.split("{line}")[0]), F.col("line_no").cast("string"), F.lit(": "), F.col("reason"))
    return staged.select(*keep, F.when(valid, "valid").otherwise("invalid").alias("status"), "reason",
                         F.when(~valid, message).alias("message"), *[F.when(valid, c).alias(k) for k, c in out.items()])


def failure_columns() -> list[Column]:
    """Aggregates of a checked batch: records seen, rejected lines, first diagnostic by line."""
    return [
        F.count(F.when(F.col("status") == "valid", 1)).alias("seen"),
        F.count(F.when(F.col("message").isNotNull(), 1)).alias("rejected"),
        F.min_by("message", F.when(F.col("message").isNotNull(), F.col("line_no"))).alias("first_error"),
    ]


def first_failure(checked: DataFrame) -> DataFrame:
    """Q1/Q2: one row — records seen (valid lines) and the first diagnostic by line."""
    return checked.agg(*failure_columns())


def parse_status(lines: DataFrame) -> DataFrame:
    """Per-line parse class — blank, malformed, not_object, object."""
    text = py_strip(F.col("line"))
    v = J.parse(text)
    return lines.select(
        "line_no",
        F.when(text == "", "blank").when(v.isNull(), "malformed")
        .when(~J.is_object(v), "not_object").otherwise("object").alias("parse_status"),
    )
