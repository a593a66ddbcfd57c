"""Stand-in inputs built from the driver's test tables.

Each adapter only reshapes test-table rows into the schema an operator
expects (a jobs store, raw JSON lines, response envelopes, event logs). The
operators themselves do all the work and would run unchanged on real feeds.
The rules are deterministic functions of each input row, so a SQL oracle can
restate them independently of the JSON built here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.schemas import DEFAULT_SOURCE, DEFAULT_URL_PREFIX
from recordlake.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- jobs store


def jobs_from_orders(orders: DataFrame, source: str = DEFAULT_SOURCE, url_prefix: str = DEFAULT_URL_PREFIX) -> DataFrame:
    """A ``jobs`` table: one job per order.

    Budgets: fixed amount = total price when key mod 3 = 0; hourly minimum =
    price/100 when key mod 3 = 1, with an hourly maximum = price/50 when that
    key is also even. ``content_hash`` holds sha256 of ``order:<key>`` (a
    stand-in value; the ingest path computes real record hashes).
    """
    k = F.col("o_orderkey")
    job_id = k.cast("string")
    seen = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        job_id.alias("job_id"),
        F.lit(source).alias("source"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.lit("order")).alias("title"),
        F.concat(F.lit("order for customer "), F.col("o_custkey").cast("string")).alias("description"),
        F.concat(F.lit(url_prefix), job_id).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"),
        F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "hourly").alias("job_type"),
        F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("contractor_tier"),
        F.when(k % 3 == 1, F.col("o_totalprice") / 100).alias("hourly_min"),
        F.when((k % 3 == 1) & (k % 2 == 0), F.col("o_totalprice") / 50).alias("hourly_max"),
        F.when(k % 3 == 0, F.col("o_totalprice")).alias("fixed_amount"),
        job_id.alias("raw_id"),
        F.sha2(F.concat(F.lit("order:"), job_id), 256).alias("content_hash"),
        seen.alias("first_seen_at"),
        seen.alias("created_at"),
    )


def job_skills_from_lineitem(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """A ``job_skills`` table: distinct (order, lower-case word of a part name).

    Part names are tokenised before the join (the smaller side), the join is
    an equi-join Spark sizes itself, and the final distinct pre-aggregates
    map-side before shuffling on (job_id, skill).
    """
    tokens = part.select(
        "p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("skill")
    ).where(F.col("skill") != "")
    lines = lineitem.select("l_orderkey", "l_partkey")
    return (
        lines.join(tokens, lines.l_partkey == tokens.p_partkey)
        .select(F.col("l_orderkey").cast("string").alias("job_id"), "skill")
        .distinct()
    )


def jobs_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    jobs = jobs_from_orders(table(spark, sf_dir, "orders"))
    skills = job_skills_from_lineitem(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))
    return jobs, skills


# --------------------------------------------------------- raw JSON lines

# Fixed fault plan: (divisor of doc_id, fault); the first divisor that matches wins.
RAW_FAULTS = (
    (41, "malformed"),
    (37, "private"),
    (31, "unknown"),
    (17, "source"),
    (29, "title"),
    (23, "skills"),
    (19, "hourly"),
)
BLANK_LINE_EVERY = 43


def raw_record_rows(documents: DataFrame, source: str = DEFAULT_SOURCE,
                    url_prefix: str = DEFAULT_URL_PREFIX) -> DataFrame:
    """``(ord, line)`` JSON lines, one per document, in ``doc_id`` order.

    id = first 16 hex digits of sha256(text) (copied texts share an id);
    title = two spaces + first 40 characters; description = text;
    skills = [lang, " "+source+"  x ", upper(lang)];
    hourly_min = n_chars mod 100 when n_chars mod 3 = 1; fixed_amount = n_chars
    when n_chars mod 3 = 0. Faults per ``RAW_FAULTS``. A whitespace-only line
    follows every document whose id is a multiple of ``BLANK_LINE_EVERY``.
    """
    d, n = F.col("doc_id"), F.col("n_chars")
    fault = F.lit(None).cast("string")
    for div, name in reversed(RAW_FAULTS):
        fault = F.when(d % div == 0, F.lit(name)).otherwise(fault)
    rid = F.substring(F.sha2(F.col("text"), 256), 1, 16)
    core = F.to_json(F.struct(
        F.when(fault == "source", F.lit("other-" + source)).otherwise(F.lit(source)).alias("source"),
        rid.alias("id"),
        F.when(fault == "title", F.lit("   ")).otherwise(F.concat(F.lit("  "), F.substring("text", 1, 40))).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit(url_prefix), rid).alias("url"),
        F.when(n % 3 == 0, n.cast("double")).alias("fixed_amount"),
        d.cast("string").alias("raw_id"),
    ))
    skills = F.when(fault == "skills", F.concat(F.lit('"'), F.col("lang"), F.lit('"'))).otherwise(
        F.to_json(F.array(F.col("lang"), F.concat(F.lit(" "), F.col("source"), F.lit("  x ")), F.upper("lang")))
    )
    hourly = F.when(fault == "hourly", F.lit('"12.5"')).when(n % 3 == 1, (n % 100).cast("string"))
    body = F.concat(
        F.lit('{"skills":'), skills,
        F.coalesce(F.concat(F.lit(',"hourly_min":'), hourly), F.lit("")),
        F.lit(","), F.expr("substring(_core, 2)"),
    )
    rest = F.expr("substring(_body, 2)")
    line = (
        F.when(fault == "malformed", rest)
        .when(fault == "private", F.concat(F.lit('{" Cookie ":"session=abc",'), rest))
        .when(fault == "unknown", F.concat(F.lit('{"zeta_note":"z","alpha_note":"a",'), rest))
        .otherwise(F.col("_body"))
    )
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars", fault.alias("_fault"))
    docs = docs.withColumn("_core", core).withColumn("_body", body.alias("_body"))
    records = docs.select((d * 2).alias("ord"), line.alias("line"))
    blanks = docs.where(d % BLANK_LINE_EVERY == 0).select((d * 2 + 1).alias("ord"), F.lit("   ").alias("line"))
    return records.unionByName(blanks)


def write_raw_records(spark: SparkSession, documents: DataFrame, path: str, parts: int | None = None,
                      mode: str = "overwrite") -> str:
    """Land the raw JSON lines as text files whose path order is line order."""
    from recordlake.sources.jsonl import write_lines

    return write_lines(raw_record_rows(documents), path, "ord", parts=parts, mode=mode)


def source_half(documents: DataFrame, first: bool) -> DataFrame:
    """Documents of sources src0–src9 (first) or src10–src19 (second)."""
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return documents.where(num < 10 if first else num >= 10)


# ------------------------------------------------------- response envelopes

# Fixed fault plan for envelopes: (divisor of conv_id, fault), first match wins.
ENVELOPE_FAULTS = (
    (13, "errors"),
    (17, "path_missing"),
    (19, "not_list"),
    (23, "item_not_object"),
    (11, "missing_identity"),
    (7, "non_decimal_id"),
)
PAGE_SIZE = 50


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def response_result_json(conversations: DataFrame) -> DataFrame:
    """One search-result JSON object per conversation turn.

    Turn t of conversation c: digits id = c*1000+t placed at ``id`` (t mod 3 = 0),
    ``uid`` (1) or ``jobTile.job.id`` (2); ciphertext ``~01``+id at ``ciphertext``
    (t mod 4 = 0) or ``jobTile.job.cipherText`` (1), none otherwise; title = first
    30 characters at the top (even t) or in the job (odd t); description / snippet /
    job description by t mod 3; skills as ``[{name}]``, ``[role, "  "]``,
    ``ontologySkills [{prefLabel}]`` or job ``[{prettyName}]`` by t mod 4;
    ``hourlyBudgetMin`` = t+0.5 as text, ``hourlyBudgetMax`` = t+10 for even t;
    ``fixedPriceAmount {amount: length}`` for t mod 3 = 2.
    """
    t, c = F.col("turn"), F.col("conv_id")
    idtxt = (c * 1000 + t).cast("string")
    head = F.substring("text", 1, 30)
    job = F.to_json(F.struct(
        F.when(t % 3 == 2, idtxt).alias("id"),
        F.when(t % 4 == 1, F.concat(F.lit("~01"), idtxt)).alias("cipherText"),
        F.when(t % 2 == 1, head).alias("title"),
        F.when(t % 3 == 2, F.col("text")).alias("description"),
        F.when(t % 4 == 3, F.array(F.struct(F.col("role").alias("prettyName")))).alias("skills"),
        (t + F.lit(0.5)).cast("string").alias("hourlyBudgetMin"),
        F.when(t % 2 == 0, t + 10).alias("hourlyBudgetMax"),
        F.when(t % 3 == 2, F.struct(F.length("text").alias("amount"))).alias("fixedPriceAmount"),
        F.when(t % 2 == 1, F.lit("FIXED")).alias("jobType"),
        F.when(F.col("role") == "assistant", F.lit("EXPERT")).alias("contractorTier"),
        F.concat(F.lit("2024-01-"), F.lpad((t + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("publishTime"),
    ))
    top = F.to_json(F.struct(
        F.when(t % 3 == 0, idtxt).alias("id"),
        F.when(t % 3 == 1, idtxt).alias("uid"),
        F.when(t % 4 == 0, F.concat(F.lit("~01"), idtxt)).alias("ciphertext"),
        F.when(t % 2 == 0, head).alias("title"),
        F.when(t % 3 == 0, F.col("text")).alias("description"),
        F.when(t % 3 == 1, F.col("text")).alias("snippet"),
        F.when(t % 2 == 0, F.lit("HOURLY")).alias("jobType"),
    ))
    inner = F.regexp_replace(top, r"^\{|\}$", "")
    skills = (
        F.when(t % 4 == 0, F.concat(F.lit(',"skills":[{"name":'), _q(F.col("role")), F.lit("}]")))
        .when(t % 4 == 1, F.concat(F.lit(',"skills":['), _q(F.col("role")), F.lit(',"  "]')))
        .when(t % 4 == 2, F.concat(F.lit(',"ontologySkills":[{"prefLabel":'), _q(F.col("role")), F.lit("}]")))
        .otherwise(F.lit(""))
    )
    obj = F.concat(
        F.lit('{"jobTile":{"job":'), job, F.lit("}"),
        F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(F.lit("")),
        skills, F.lit("}"),
    )
    return conversations.select("conv_id", "turn", obj.alias("result"))


def response_rows(conversations: DataFrame, path: str = "$.data.search.universalSearchNuxt.visitorJobSearchV1.results",
                  faults: bool = True) -> DataFrame:
    """``(ord, line)``: one response envelope per (conversation, page of 50 turns).

    Faults per ``ENVELOPE_FAULTS``: an ``errors`` envelope, a missing results
    path, results as an object, a trailing non-object item, a trailing result
    without any identity, a trailing result with a non-digit id and no ciphertext.
    """
    c = F.col("conv_id")
    fault = F.lit(None).cast("string")
    for div, name in (reversed(ENVELOPE_FAULTS) if faults else ()):
        fault = F.when(c % div == 0, F.lit(name)).otherwise(fault)
    pages = (
        response_result_json(conversations)
        .withColumn("page", F.floor(F.col("turn") / PAGE_SIZE))
        .groupBy("conv_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "result"))).alias("rs"))
    )
    results = F.concat_ws(",", F.transform("rs", lambda x: x["result"]))
    extra = (
        F.when(fault == "item_not_object", F.lit(",5"))
        .when(fault == "missing_identity", F.lit(',{"title":"no id","description":"missing identity"}'))
        .when(fault == "non_decimal_id", F.lit(',{"id":"abc","title":"t","description":"d"}'))
        .otherwise(F.lit(""))
    )
    n = F.size("rs").cast("string")
    keys = path.lstrip("$.").split(".")
    opening = "".join('{"' + k + '":' for k in keys[:-1])
    closing = "}" * (len(keys) - 1)
    ok_body = F.concat(
        F.lit(opening + '{"paging":{"total":'), n, F.lit(',"offset":0,"count":'), n,
        F.lit('},"' + keys[-1] + '":['), results, extra, F.lit("]}" + closing),
    )
    body = (
        F.when(fault == "errors", F.lit('{"errors":[{"message":"boom"}],"data":null}'))
        .when(fault == "path_missing", F.lit('{"' + keys[0] + '":{"' + keys[1] + '":{}}}'))
        .when(fault == "not_list", F.lit(opening + '{"' + keys[-1] + '":{}}' + closing))
        .otherwise(ok_body)
    )
    return pages.select(F.struct(c.alias("conv_id"), "page").alias("ord"), body.alias("line"))


def write_responses(spark: SparkSession, conversations: DataFrame, path: str, parts: int | None = None,
                    faults: bool = True) -> str:
    from recordlake.sources.jsonl import write_lines

    return write_lines(response_rows(conversations, faults=faults), path, "ord", parts=parts)


def land_query_pages(spark: SparkSession, conversations: DataFrame, landing: str) -> list[str]:
    """Landing folders for a scheduled run: ``q_even`` / ``q_odd`` hold the clean
    envelopes of even / odd conversations, ``q_again`` all of them once more
    (a re-fetch, so every record is a duplicate); ``q_missing`` is configured
    but never landed."""
    parity = F.col("conv_id") % 2
    write_responses(spark, conversations.where(parity == 0), f"{landing}/query=q_even", faults=False)
    write_responses(spark, conversations.where(parity == 1), f"{landing}/query=q_odd", faults=False)
    write_responses(spark, conversations, f"{landing}/query=q_again", faults=False)
    return ["q_even", "q_odd", "q_again", "q_missing"]


# ------------------------------------------------------------- event logs


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _sec(c: str = "ts") -> Column:
    return F.date_trunc("second", F.col(c).cast("timestamp"))


def http_log(events: DataFrame) -> DataFrame:
    """Response/attempt log: one fetch attempt per event.

    status by event type (view 200, click 403, error 500, signup 429,
    purchase 404); body ``Forbidden`` when k mod 15 = 0, ``rate limit hit``
    when k mod 10 = 0, else ``body <k>``; run = user-day; query = q<user mod 10>;
    attempt number 1 + k mod 3.
    """
    k = _k()
    status = (
        F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 403)
        .when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429)
        .otherwise(404)
    )
    body = (
        F.when(k % 15 == 0, F.lit("Forbidden")).when(k % 10 == 0, F.lit("rate limit hit"))
        .otherwise(F.concat(F.lit("body "), k.cast("string")))
    )
    return events.select(
        "event_id", _sec().alias("ts"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("query"),
        status.alias("status"), body.alias("body"), (1 + k % 3).alias("attempt_no"),
    )


def run_results(events: DataFrame) -> DataFrame:
    """Per-query result rows: one per event, run = user-day.

    failed for ``error`` events (zero counters, error type and message),
    else success with seen = k, inserted = floor(k/3); attempts 1 + k mod 3;
    finished k mod 7 seconds after start.
    """
    k = _k()
    failed = F.col("event_type") == "error"
    start = _sec()
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").alias("query_ix"),
        F.col("event_type").alias("query"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        (1 + k % 3).cast("long").alias("attempts"),
        F.when(failed, 0).otherwise(k).cast("long").alias("seen_count"),
        F.when(failed, 0).otherwise(F.floor(k / 3)).cast("long").alias("inserted_count"),
        F.when(failed, 0).otherwise(k - F.floor(k / 3)).cast("long").alias("skipped_count"),
        F.when(failed, F.lit("UpstreamSchemaOrTemporaryError")).alias("error_type"),
        F.when(failed, F.concat(F.lit("upstream temporary server failure token="), k.cast("string"))).alias("error_text"),
        start.alias("started_at"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 7).cast("decimal(8,6)"))).alias("finished_at"),
    )


def run_events(events: DataFrame) -> DataFrame:
    """Run status log: every event updates its run (user-day).

    status failed for ``error``, running when k mod 20 = 0, else success;
    trigger by user mod 3 (scheduled, worker_interval, mcp_run_once).
    """
    k = _k()
    status = F.when(F.col("event_type") == "error", "failed").when(k % 20 == 0, "running").otherwise("success")
    trig = F.element_at(F.array(F.lit("scheduled"), F.lit("worker_interval"), F.lit("mcp_run_once")),
                        (F.col("user_id") % 3 + 1).cast("int"))
    failed = F.col("event_type") == "error"
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").alias("seq"), _sec().alias("ts"), status.alias("status"), trig.alias("trigger"),
        F.when(failed, F.lit("UpstreamSchemaOrTemporaryError")).alias("error_type"),
        F.when(failed, F.concat(F.lit("upstream temporary server failure token="), k.cast("string"))).alias("error_text"),
    )


COMMAND_TYPES_BY_MOD = ("run_once", "pause", "resume", "update_config")


def command_events(events: DataFrame) -> DataFrame:
    """Command lifecycle log: command = event_id div 4, seq = event_id.

    status view running, purchase applied, error failed, else queued;
    type by command mod 4 (run_once, pause, resume, update_config);
    update payload ``{"updates":{"max_pages":k mod 5 + 1}}``, or an unknown key
    when k mod 7 = 0. Applied events have the result ``{"k":k}``, failed ones an error.
    """
    k = _k()
    cid = F.floor(F.col("event_id") / 4)
    et = F.col("event_type")
    status = F.when(et == "view", "running").when(et == "purchase", "applied").when(et == "error", "failed").otherwise("queued")
    ctype = F.element_at(F.array(*[F.lit(t) for t in COMMAND_TYPES_BY_MOD]), (cid % 4 + 1).cast("int"))
    payload = F.when(ctype == "update_config", F.when(
        k % 7 == 0, F.lit('{"updates":{"bogus":1}}')
    ).otherwise(F.concat(F.lit('{"updates":{"max_pages":'), (k % 5 + 1).cast("string"), F.lit("}}")))
    ).otherwise(F.lit("{}"))
    return events.select(
        F.concat(F.lit("cmd-"), F.lpad(cid.cast("string"), 6, "0")).alias("command_id"),
        F.col("event_id").alias("seq"), _sec().alias("ts"), status.alias("status"),
        ctype.alias("command_type"), payload.alias("payload_json"), F.lit("mcp").alias("requested_by"),
        F.when(status == "applied", F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).alias("result_json"),
        F.when(status == "failed", F.lit("UpstreamBlockedError")).alias("error_type"),
        F.when(status == "failed", F.concat(F.lit("blocked "), k.cast("string"))).alias("redacted_error"),
    )


CONFIG_KEY_BY_MOD = ("interval_seconds", "queries", "max_pages", "page_size", "paused", "colour")


def config_events(events: DataFrame) -> DataFrame:
    """Config update log: scope = user, key = k mod 6 over the five config keys
    and one unknown key; value by event type: view → k+1, click → "0" (text),
    signup → true, error → "text", purchase → [" a ", "b"] (or ["", "b"] when k is even)."""
    k = _k()
    key = F.element_at(F.array(*[F.lit(x) for x in CONFIG_KEY_BY_MOD]), (k % 6 + 1).cast("int"))
    et = F.col("event_type")
    value = (
        F.when(et == "view", (k + 1).cast("string")).when(et == "click", F.lit('"0"'))
        .when(et == "signup", F.lit("true")).when(et == "error", F.lit('"text"'))
        .otherwise(F.when(k % 2 == 0, F.lit('["", "b"]')).otherwise(F.lit('[" a ", "b"]')))
    )
    return events.select(
        F.col("user_id").cast("string").alias("scope"), key.alias("key"), value.alias("value_json"),
        _sec().alias("ts"), F.col("event_id").alias("seq"), F.lit("mcp").alias("updated_by"),
    )
