"""DuckDB SQL oracles for the query catalogue.

Each statement restates the adapter rules and the operator semantics in plain
SQL over the raw test tables, independently of the Spark code.
"""

from __future__ import annotations

SOURCE = "feed"
URL_PREFIX = "https://jobs.example/jobs/"

JOBS_CTE = f"""
jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
         '{SOURCE}' AS source,
         concat_ws(' ', o_orderpriority, o_orderstatus, 'order') AS title,
         'order for customer ' || CAST(o_custkey AS VARCHAR) AS description,
         '{URL_PREFIX}' || CAST(o_orderkey AS VARCHAR) AS url,
         strftime(o_orderdate, '%Y-%m-%d') AS posted_at,
         CASE WHEN o_orderkey % 3 = 0 THEN 'fixed' WHEN o_orderkey % 3 = 1 THEN 'hourly' END AS job_type,
         lower(regexp_extract(o_orderpriority, '[^-]*$')) AS contractor_tier,
         CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice / 100 END AS hourly_min,
         CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN o_totalprice / 50 END AS hourly_max,
         CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS fixed_amount,
         CAST(o_orderkey AS VARCHAR) AS raw_id,
         sha256('order:' || CAST(o_orderkey AS VARCHAR)) AS content_hash,
         o_orderdate AS first_seen_at,
         o_orderdate AS created_at
    FROM orders
)"""

SKILLS_CTE = """
job_skills AS (
  SELECT DISTINCT CAST(l.l_orderkey AS VARCHAR) AS job_id, t.skill
    FROM lineitem l
    JOIN (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS skill FROM part) t
      ON l.l_partkey = t.p_partkey
   WHERE t.skill <> ''
)"""

STORE = f"WITH {JOBS_CTE},{SKILLS_CTE}"

ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _detailed(where: str = "", limit: int | None = 20) -> str:
    lim = f"ORDER BY first_seen_at DESC, job_id ASC LIMIT {limit}" if limit else ""
    return f"""{STORE},
page AS (SELECT * FROM jobs {where} {lim}),
sk AS (SELECT job_id, string_agg(skill, ',' ORDER BY skill) AS skills
         FROM job_skills WHERE job_id IN (SELECT job_id FROM page) GROUP BY job_id)
SELECT p.job_id, p.source, p.title, p.description, p.url, coalesce(sk.skills, '') AS skills,
       p.posted_at, p.job_type, p.contractor_tier, p.hourly_min, p.hourly_max, p.fixed_amount,
       p.raw_id, p.content_hash, strftime(p.first_seen_at, {ISO}) AS first_seen_at,
       strftime(p.created_at, {ISO}) AS created_at
  FROM page p LEFT JOIN sk USING (job_id)"""


def _analytics_list(where: str, limit: int) -> str:
    return f"""{STORE}
SELECT job_id, title, url, job_type, hourly_min, hourly_max, fixed_amount,
       strftime(first_seen_at, {ISO}) AS first_seen_at, strftime(created_at, {ISO}) AS created_at
  FROM jobs {where}
 ORDER BY jobs.first_seen_at DESC, job_id ASC LIMIT {limit}"""


def _has_skill(skill: str) -> str:
    return f"EXISTS (SELECT 1 FROM job_skills js WHERE js.job_id = jobs.job_id AND js.skill = '{skill}')"


ORACLE: dict[str, str] = {
    "summary": f"{STORE} SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM job_skills) AS skills",
    "skill_frequency": f"{STORE} SELECT skill, count(*) AS count FROM job_skills GROUP BY skill ORDER BY count DESC, skill",
    "budget_distribution": f"""{STORE}
SELECT CASE WHEN fixed_amount IS NOT NULL THEN 'fixed'
            WHEN hourly_min IS NOT NULL OR hourly_max IS NOT NULL THEN 'hourly'
            ELSE 'unknown' END AS budget_type,
       count(*) AS count, min(hourly_min) AS min_hourly_min, max(hourly_max) AS max_hourly_max,
       min(fixed_amount) AS min_fixed_amount, max(fixed_amount) AS max_fixed_amount
  FROM jobs GROUP BY 1 ORDER BY 1""",
    "jobs_list": _analytics_list("", 100),
    "jobs_list_filtered": _analytics_list(
        f"WHERE {_has_skill('widget')} AND lower(title) LIKE '%high%'", 50),
    "recent": _detailed(),
    "search_title": _detailed("WHERE lower(title) LIKE '%urgent%'"),
    "search_skill": _detailed(f"WHERE {_has_skill('ring')}"),
    "search_both": _detailed(f"WHERE lower(title) LIKE '%low%' AND {_has_skill('blue')}"),
    "search_wildcard": _detailed("WHERE lower(title) LIKE '%1_urg%t%'"),
    "get_one": _detailed("WHERE job_id = '7'", None),
    "get_missing": _detailed("WHERE job_id = 'no-such-job'", None),
    "skills_for_page": f"""{STORE},
page AS (SELECT job_id FROM jobs ORDER BY first_seen_at DESC, job_id ASC LIMIT 100)
SELECT p.job_id, coalesce(string_agg(js.skill, ',' ORDER BY js.skill), '') AS skills
  FROM page p LEFT JOIN job_skills js USING (job_id) GROUP BY p.job_id""",
}


# ------------------------------------------------------ raw JSON lines

WS = r"'^\s+|\s+$'"


def _raw(where: str = "") -> str:
    """CTEs d (docs + fault + line_no), r (reason per record line), ck (canonical skills)."""
    return rf"""
d0 AS (
  SELECT doc_id, text, lang, source, n_chars,
         CASE WHEN doc_id % 41 = 0 THEN 'malformed' WHEN doc_id % 37 = 0 THEN 'private'
              WHEN doc_id % 31 = 0 THEN 'unknown' WHEN doc_id % 17 = 0 THEN 'source'
              WHEN doc_id % 29 = 0 THEN 'title' WHEN doc_id % 23 = 0 THEN 'skills'
              WHEN doc_id % 19 = 0 THEN 'hourly' END AS fault,
         substr(sha256(text), 1, 16) AS rid
    FROM documents {where}),
d AS (
  SELECT *, CAST(row_number() OVER (ORDER BY doc_id)
            + coalesce(sum(CASE WHEN doc_id % 43 = 0 THEN 1 ELSE 0 END)
                 OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no,
         regexp_replace(CASE WHEN fault = 'title' THEN '   ' ELSE '  ' || left(text, 40) END, {WS}, '', 'g') AS title_s,
         regexp_replace(text, {WS}, '', 'g') AS desc_s,
         CASE WHEN n_chars % 3 = 1 THEN CAST(n_chars % 100 AS DOUBLE) END AS hourly_min,
         CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars AS DOUBLE) END AS fixed_amount
    FROM d0),
r AS (
  SELECT *,
         CASE WHEN fault = 'malformed' THEN NULL
              WHEN fault = 'private' THEN 'collector payload contains disallowed private field:  Cookie '
              WHEN fault = 'unknown' THEN 'collector payload contains unsupported fields: alpha_note, zeta_note'
              WHEN fault = 'source' THEN 'collector field source must be ''{SOURCE}'''
              WHEN title_s = '' THEN 'record missing required collector field: title'
              WHEN desc_s = '' THEN 'record missing required collector field: description'
              WHEN fault = 'skills' THEN 'record missing required collector field: skills'
              WHEN fault = 'hourly' THEN 'collector field must be numeric or null: hourly_min'
         END AS reason
    FROM d),
v AS (SELECT * FROM r WHERE fault IS NULL AND reason IS NULL),
ck0 AS (
  SELECT line_no, i, lower(regexp_replace(regexp_replace(l[i], '\s+', ' ', 'g'), {WS}, '', 'g')) AS skill
    FROM (SELECT line_no, [lang, ' ' || source || '  x ', upper(lang)] AS l FROM v) s, range(1, 4) t(i)),
ck AS (
  SELECT line_no, skill, CAST(row_number() OVER (PARTITION BY line_no ORDER BY i) AS INTEGER) AS pos
    FROM (SELECT *, min(i) OVER (PARTITION BY line_no, skill) AS first_i FROM ck0 WHERE skill <> '') x
   WHERE i = first_i),
cks AS (SELECT line_no, string_agg(skill, ',' ORDER BY pos) AS skills FROM ck GROUP BY line_no)"""


def _batches() -> str:
    """Two batch files: sources src0–9 (batch 1) and src10–19 (batch 2)."""
    half1 = "WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) < 10"
    half2 = "WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) >= 10"
    return (
        "WITH " + _rename(_raw(half1), "b1_") + ",\n" + _rename(_raw(half2), "b2_") + """,
allv AS (SELECT CAST(1 AS BIGINT) AS batch_id, * FROM b1_v UNION ALL SELECT CAST(2 AS BIGINT) AS batch_id, * FROM b2_v),
allr AS (SELECT CAST(1 AS BIGINT) AS batch_id, * FROM b1_r UNION ALL SELECT CAST(2 AS BIGINT) AS batch_id, * FROM b2_r),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY batch_id, line_no) AS rn FROM allv) x
         WHERE rn = 1)"""
    )


def _rename(sql: str, prefix: str) -> str:
    import re as _re

    for name in ("ck0", "cks", "ck", "d0", "d", "r", "v"):
        sql = _re.sub(rf"(?<![\w.]){name} AS \(", f"{prefix}{name} AS (", sql)
        sql = _re.sub(rf"FROM {name}(?=[\s)])", f"FROM {prefix}{name}", sql)
    return sql


RAW = "WITH " + _raw()
ORACLE.update({
    "jsonl_parse_status": f"""{RAW}
SELECT line_no, CASE WHEN fault = 'malformed' THEN 'malformed' ELSE 'object' END AS parse_status FROM d
UNION ALL SELECT line_no + 1, 'blank' FROM d WHERE doc_id % 43 = 0""",
    "validate_reasons": f"""{RAW}
SELECT line_no, CASE WHEN fault = 'malformed' THEN 'malformed' ELSE 'invalid' END AS status,
       CASE WHEN fault = 'malformed' THEN 'malformed JSONL at line ' || line_no
            ELSE 'invalid collector record at line ' || line_no || ': ' || reason END AS message
  FROM r WHERE fault = 'malformed' OR reason IS NOT NULL""",
    "validate_accepted": f"""{RAW}
SELECT v.line_no, rid AS job_id, '{SOURCE}' AS source, title_s AS title, desc_s AS description,
       '{URL_PREFIX}' || rid AS url, cks.skills, hourly_min, fixed_amount, CAST(doc_id AS VARCHAR) AS raw_id
  FROM v JOIN cks USING (line_no)""",
    "private_field_rejects": f"{RAW} SELECT line_no, reason FROM r WHERE fault = 'private'",
    "unknown_field_rejects": f"{RAW} SELECT line_no, reason FROM r WHERE fault = 'unknown'",
    "skill_canonical": f"{RAW} SELECT line_no, pos, skill FROM ck",
    "content_hash": f"""{RAW}
SELECT line_no, sha256(to_json({{
  'contractor_tier': NULL::VARCHAR, 'description': text, 'fixed_amount': fixed_amount,
  'hourly_max': NULL::DOUBLE, 'hourly_min': hourly_min, 'id': rid, 'job_type': NULL::VARCHAR,
  'posted_at': NULL::VARCHAR, 'raw_id': CAST(doc_id AS VARCHAR),
  'skills': [lang, ' ' || source || '  x ', upper(lang)], 'source': '{SOURCE}',
  'title': '  ' || left(text, 40), 'url': '{URL_PREFIX}' || rid}})) AS content_hash
  FROM v""",
    "ingest_counters": f"""{RAW}
SELECT CAST(1 AS BIGINT) AS batch_id, (SELECT count(*) FROM v) AS seen, (SELECT count(DISTINCT rid) FROM v) AS inserted,
       (SELECT count(*) FROM v) - (SELECT count(DISTINCT rid) FROM v) AS skipped,
       (SELECT count(*) FROM r WHERE fault = 'malformed' OR reason IS NOT NULL) AS rejected""",
    "new_jobs": f"""{RAW},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line_no) AS rn FROM v) x WHERE rn = 1)
SELECT rid AS job_id, '{SOURCE}' AS source, title_s AS title, desc_s AS description, '{URL_PREFIX}' || rid AS url,
       cks.skills, NULL::VARCHAR AS posted_at, NULL::VARCHAR AS job_type, NULL::VARCHAR AS contractor_tier,
       hourly_min, NULL::DOUBLE AS hourly_max, fixed_amount, CAST(doc_id AS VARCHAR) AS raw_id
  FROM w JOIN cks USING (line_no)""",
    "ingest_skill_frequency": f"""{RAW},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line_no) AS rn FROM v) x WHERE rn = 1)
SELECT ck.skill, count(*) AS count FROM w JOIN ck USING (line_no) GROUP BY ck.skill ORDER BY count DESC, skill""",
    "new_job_skills": f"""{RAW},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line_no) AS rn FROM v) x WHERE rn = 1)
SELECT w.rid AS job_id, ck.skill FROM w JOIN ck USING (line_no)""",
})


BATCHES = _batches()
ORACLE.update({
    "insert_if_new": f"""{BATCHES}
SELECT w.rid AS job_id, w.line_no AS ord, w.title_s AS title, '{URL_PREFIX}' || w.rid AS url, c.skills,
       w.hourly_min, w.fixed_amount, CAST(w.doc_id AS VARCHAR) AS raw_id
  FROM win w JOIN b2_cks c USING (line_no) WHERE w.batch_id = 2""",
    "two_batch_first_wins": f"""{BATCHES}
SELECT rid AS job_id, batch_id, line_no AS ord, CAST(doc_id AS VARCHAR) AS raw_id FROM win""",
    "replay_idempotent": f"""{BATCHES},
seen AS (SELECT batch_id, count(*) AS seen FROM allv GROUP BY batch_id),
ins AS (SELECT batch_id, count(*) AS inserted FROM win GROUP BY batch_id),
rej AS (SELECT batch_id, count(*) AS rejected FROM allr WHERE fault = 'malformed' OR reason IS NOT NULL GROUP BY batch_id)
SELECT s.batch_id, s.seen, coalesce(i.inserted, 0) AS inserted, s.seen - coalesce(i.inserted, 0) AS skipped,
       coalesce(j.rejected, 0) AS rejected, i.inserted AS stored
  FROM seen s LEFT JOIN ins i USING (batch_id) LEFT JOIN rej j USING (batch_id)""",
})


# ------------------------------------------------- envelopes & normaliser

ENV = rf"""WITH cv AS (
  SELECT conv_id, turn, role, text, turn // 50 AS page,
         CASE WHEN conv_id % 13 = 0 THEN 'errors' WHEN conv_id % 17 = 0 THEN 'path_missing'
              WHEN conv_id % 19 = 0 THEN 'not_list' WHEN conv_id % 23 = 0 THEN 'item_not_object'
              WHEN conv_id % 11 = 0 THEN 'missing_identity' WHEN conv_id % 7 = 0 THEN 'non_decimal_id' END AS fault
    FROM conversations),
resp AS (
  SELECT conv_id, page, any_value(fault) AS fault, count(*) AS n,
         row_number() OVER (ORDER BY conv_id, page) AS line_no
    FROM cv GROUP BY conv_id, page),
aud AS (
  SELECT *, CASE fault WHEN 'errors' THEN 'errors_present' WHEN 'path_missing' THEN 'path_missing'
                       WHEN 'not_list' THEN 'not_list' WHEN 'item_not_object' THEN 'item_not_object'
                       ELSE 'ok' END AS audit_class,
         CASE fault WHEN 'errors' THEN 'upstream GraphQL returned errors'
                    WHEN 'path_missing' THEN 'upstream response missing job results path'
                    WHEN 'not_list' THEN 'upstream job results path is not a list'
                    WHEN 'item_not_object' THEN 'upstream job result item is not an object' END AS audit_error
    FROM resp),
t AS (
  SELECT a.line_no, a.audit_class, a.fault, a.n, cv.conv_id, cv.turn, cv.role, cv.text,
         CAST(row_number() OVER (PARTITION BY a.line_no ORDER BY cv.turn) - 1 AS INTEGER) AS pos,
         CAST(cv.conv_id * 1000 + cv.turn AS VARCHAR) AS idtxt,
         regexp_replace(left(cv.text, 30), {WS}, '', 'g') AS title_s,
         regexp_replace(cv.text, {WS}, '', 'g') AS desc_s
    FROM cv JOIN aud a ON cv.conv_id = a.conv_id AND cv.page = a.page),
te AS (
  SELECT *, CASE WHEN title_s = '' OR desc_s = '' THEN 'job result missing title or description' END AS item_error FROM t),
rerr AS (
  SELECT a.line_no, a.audit_class,
         coalesce(a.audit_error,
                  (SELECT min_by(item_error, pos) FROM te WHERE te.line_no = a.line_no AND item_error IS NOT NULL),
                  CASE a.fault WHEN 'missing_identity' THEN 'job result missing required raw identity field'
                               WHEN 'non_decimal_id' THEN 'job result missing required ciphertext for permalink' END)
           AS error
    FROM aud a),
rec AS (
  SELECT te.line_no, te.pos,
         CASE WHEN turn % 4 IN (0, 1) THEN '~01' || idtxt ELSE '~02' || idtxt END AS job_id,
         '{SOURCE}' AS source, title_s AS title, desc_s AS description,
         '{URL_PREFIX}' || CASE WHEN turn % 4 IN (0, 1) THEN '~01' || idtxt ELSE '~02' || idtxt END AS url,
         role AS skills,
         '2024-01-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS posted_at,
         CASE WHEN turn % 2 = 0 THEN 'HOURLY' ELSE 'FIXED' END AS job_type,
         CASE WHEN role = 'assistant' THEN 'EXPERT' END AS contractor_tier,
         CAST(turn + 0.5 AS DOUBLE) AS hourly_min,
         CASE WHEN turn % 2 = 0 THEN CAST(turn + 10 AS DOUBLE) END AS hourly_max,
         CASE WHEN turn % 3 = 2 THEN CAST(length(text) AS DOUBLE) END AS fixed_amount,
         idtxt AS raw_id
    FROM te JOIN rerr USING (line_no) WHERE rerr.error IS NULL)"""

ORACLE.update({
    "envelope_audit": f"{ENV} SELECT line_no, audit_class FROM aud",
    "envelope_extract": f"""{ENV}
SELECT line_no, pos, CASE WHEN turn % 3 IN (0, 1) THEN idtxt END AS top_id FROM t WHERE audit_class = 'ok'
UNION ALL
SELECT line_no, CAST(n AS INTEGER) AS pos, CASE WHEN fault = 'non_decimal_id' THEN 'abc' END AS top_id
  FROM aud WHERE fault IN ('missing_identity', 'non_decimal_id')""",
    "normalize_records": f"""{ENV}
SELECT line_no, pos, job_id, source, title, description, url, posted_at, job_type, contractor_tier, raw_id FROM rec""",
    "normalize_rejects": f"{ENV} SELECT line_no, audit_class, error FROM rerr WHERE error IS NOT NULL",
    "normalize_skills": f"{ENV} SELECT line_no, pos, skills FROM rec",
    "normalize_budgets": f"{ENV} SELECT line_no, pos, hourly_min, hourly_max, fixed_amount FROM rec",
    "jsonl_roundtrip": f"""{ENV}
SELECT job_id, title, url, skills, posted_at, job_type, contractor_tier, hourly_min, hourly_max, fixed_amount,
       raw_id FROM rec""",
})


# -------------------------------------------------- audit, ledger, control

from recordlake.functions.redact import STEPS


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _redact_sql(col: str) -> str:
    for pattern, replacement in STEPS:
        to = replacement.replace("{", "\\").replace("}", "")
        col = f"regexp_replace({col}, {_sql_str(pattern)}, '{to}', 'g')"
    return col


EV = """WITH e AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS run_id,
         date_trunc('second', ts) AS ts_s
    FROM events)"""

HTTP = EV + """,
h AS (
  SELECT event_id, run_id, 'q' || CAST(user_id % 10 AS VARCHAR) AS query, 1 + k % 3 AS attempt_no,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'error' THEN 500
                         WHEN 'signup' THEN 429 ELSE 404 END AS status,
         CASE WHEN k % 15 = 0 THEN 'Forbidden' WHEN k % 10 = 0 THEN 'rate limit hit'
              ELSE 'body ' || CAST(k AS VARCHAR) END AS body
    FROM e),
c AS (
  SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok'
                 WHEN status IN (401, 403) OR lower(body) LIKE '%access denied%' OR lower(body) LIKE '%forbidden%' THEN 'blocked'
                 WHEN status = 429 OR lower(body) LIKE '%rate limit%' OR lower(body) LIKE '%throttle%' THEN 'rate_limited'
                 WHEN status >= 500 THEN 'temporary' ELSE 'passed' END AS response_class
    FROM h),
cc AS (
  SELECT *, CASE response_class WHEN 'blocked' THEN 1 WHEN 'rate_limited' THEN 2 WHEN 'temporary' THEN 3 END AS retry_cap
    FROM c)"""

RUNS = EV + f""",
res AS (
  SELECT run_id, event_id AS id, event_type AS query,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(1 + k % 3 AS BIGINT) AS attempts,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE k END AS BIGINT) AS seen_count,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE k // 3 END AS BIGINT) AS inserted_count,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE k - k // 3 END AS BIGINT) AS skipped_count,
         CASE WHEN event_type = 'error' THEN 'UpstreamSchemaOrTemporaryError' END AS error_type,
         CASE WHEN event_type = 'error' THEN 'upstream temporary server failure token=' || CAST(k AS VARCHAR) END AS error_text,
         ts_s AS started, ts_s + to_seconds(k % 7) AS finished
    FROM e),
ev AS (
  SELECT run_id, event_id AS seq, ts_s AS ts,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN k % 20 = 0 THEN 'running' ELSE 'success' END AS status,
         CASE user_id % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'worker_interval' ELSE 'mcp_run_once' END AS trigger,
         CASE WHEN event_type = 'error' THEN 'UpstreamSchemaOrTemporaryError' END AS error_type,
         CASE WHEN event_type = 'error' THEN 'upstream temporary server failure token=' || CAST(k AS VARCHAR) END AS error_text
    FROM e),
lst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
                   ORDER BY ts DESC, CASE WHEN status = 'running' THEN 0 ELSE 1 END DESC, seq DESC) AS rn FROM ev) x
   WHERE rn = 1),
fst AS (
  SELECT run_id, min(ts) AS started, arg_min(trigger, seq) AS trigger FROM ev GROUP BY run_id),
tot AS (
  SELECT run_id, count(*) AS query_count,
         CAST(coalesce(sum(CASE WHEN status = 'success' THEN seen_count END), 0) AS BIGINT) AS total_seen,
         CAST(coalesce(sum(CASE WHEN status = 'success' THEN inserted_count END), 0) AS BIGINT) AS total_inserted,
         CAST(coalesce(sum(CASE WHEN status = 'success' THEN skipped_count END), 0) AS BIGINT) AS total_skipped
    FROM res GROUP BY run_id),
runs AS (
  SELECT f.run_id, strftime(f.started, {ISO}) AS started_at,
         CASE WHEN l.status <> 'running' THEN strftime(l.ts, {ISO}) END AS finished_at,
         CASE WHEN l.status <> 'running' THEN CAST(epoch(l.ts) - epoch(f.started) AS BIGINT) END AS duration_seconds,
         l.status, f.trigger,
         CAST(coalesce(t.query_count, 0) AS BIGINT) AS query_count,
         CAST(coalesce(t.total_seen, 0) AS BIGINT) AS total_seen,
         CAST(coalesce(t.total_inserted, 0) AS BIGINT) AS total_inserted,
         CAST(coalesce(t.total_skipped, 0) AS BIGINT) AS total_skipped,
         CASE WHEN l.status = 'failed' THEN l.error_type END AS error_type,
         CASE WHEN l.status = 'failed' THEN {_redact_sql('l.error_text')} END AS redacted_error
    FROM fst f JOIN lst l USING (run_id) LEFT JOIN tot t USING (run_id)),
latest AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1),
rres AS (
  SELECT id, run_id, query, status, attempts, seen_count, inserted_count, skipped_count, error_type,
         {_redact_sql('error_text')} AS redacted_error,
         strftime(started, {ISO}) AS started_at, strftime(finished, {ISO}) AS finished_at
    FROM res)"""

CMDS = EV + f""",
ce AS (
  SELECT 'cmd-' || lpad(CAST(event_id // 4 AS VARCHAR), 6, '0') AS command_id, event_id AS seq, ts_s AS ts,
         CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'failed'
                         ELSE 'queued' END AS status,
         CASE (event_id // 4) % 4 WHEN 0 THEN 'run_once' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume'
                                  ELSE 'update_config' END AS command_type,
         CASE WHEN (event_id // 4) % 4 = 3 THEN
                CASE WHEN k % 7 = 0 THEN '{{"updates":{{"bogus":1}}}}'
                     ELSE '{{"updates":{{"max_pages":' || CAST(k % 5 + 1 AS VARCHAR) || '}}}}' END
              ELSE '{{}}' END AS payload_json,
         CASE event_type WHEN 'purchase' THEN '{{"k":' || CAST(k AS VARCHAR) || '}}' END AS result_json,
         CASE event_type WHEN 'error' THEN 'UpstreamBlockedError' END AS error_type,
         CASE event_type WHEN 'error' THEN 'blocked ' || CAST(k AS VARCHAR) END AS redacted_error,
         k
    FROM e),
rk AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS rnk FROM ce),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY ts DESC, rnk DESC, seq DESC) AS rn
                        FROM rk) x WHERE rn = 1),
cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY ts, seq) AS rn FROM rk) x
        WHERE rn = 1),
ct AS (
  SELECT command_id, coalesce(min(ts) FILTER (WHERE status = 'queued'), min(ts)) AS created,
         min(ts) FILTER (WHERE status = 'running') AS started,
         min(ts) FILTER (WHERE status IN ('applied', 'failed')) AS finished
    FROM rk GROUP BY command_id),
cs AS (
  SELECT cf.command_id, cf.command_type, cf.payload_json, cl.status, strftime(ct.created, {ISO}) AS created_at,
         strftime(ct.started, {ISO}) AS started_at, strftime(ct.finished, {ISO}) AS finished_at,
         'mcp' AS requested_by, cl.result_json, cl.error_type, cl.redacted_error, cl.ts AS applied_ts, cl.seq AS applied_seq, cf.k AS first_k
    FROM cf JOIN cl USING (command_id) JOIN ct USING (command_id))"""

CFG = EV + """,
cfg AS (
  SELECT CAST(user_id AS VARCHAR) AS scope,
         CASE k % 6 WHEN 0 THEN 'interval_seconds' WHEN 1 THEN 'queries' WHEN 2 THEN 'max_pages'
                    WHEN 3 THEN 'page_size' WHEN 4 THEN 'paused' ELSE 'colour' END AS key,
         event_type, k, ts_s AS ts, event_id AS seq, 'mcp' AS updated_by,
         CASE event_type WHEN 'view' THEN CAST(k + 1 AS VARCHAR) WHEN 'click' THEN '"0"' WHEN 'signup' THEN 'true'
                         WHEN 'error' THEN '"text"'
                         ELSE CASE WHEN k % 2 = 0 THEN '["", "b"]' ELSE '[" a ", "b"]' END END AS value_json
    FROM e),
val AS (
  SELECT *, CASE WHEN key = 'colour' THEN 'unsupported config keys: colour'
                 WHEN key IN ('interval_seconds', 'max_pages', 'page_size') AND event_type <> 'view'
                   THEN key || ' must be a positive integer'
                 WHEN key = 'paused' AND event_type <> 'signup' THEN 'paused must be a boolean'
                 WHEN key = 'queries' AND NOT (event_type = 'purchase' AND k % 2 = 1)
                   THEN 'queries must be a list of non-empty strings' END AS error
    FROM cfg),
cur AS (
  SELECT scope, key, value_json, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, updated_by
    FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY ts DESC, seq DESC) AS rn
            FROM val WHERE error IS NULL) x WHERE rn = 1)"""

DEFAULTS = """defaults AS (
  SELECT * FROM (VALUES ('interval_seconds', '3600'), ('queries', '[]'), ('max_pages', '5'),
                        ('page_size', '50'), ('paused', 'false')) t(key, default_json))"""

AFTER = CMDS + f""",
chg AS (
  SELECT 'paused' AS key, CASE command_type WHEN 'pause' THEN 'true' ELSE 'false' END AS value_json,
         applied_ts AS ts, applied_seq AS seq
    FROM cs WHERE status = 'applied' AND command_type IN ('pause', 'resume')
  UNION ALL
  SELECT 'max_pages', CAST(first_k % 5 + 1 AS VARCHAR), applied_ts, applied_seq
    FROM cs WHERE status = 'applied' AND command_type = 'update_config' AND first_k % 7 <> 0),
fin AS (SELECT key, value_json FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn
                                       FROM chg) x WHERE rn = 1),
{DEFAULTS},
wcfg AS (
  SELECT 'worker' AS scope, d.key, coalesce(f.value_json, d.default_json) AS value_json,
         CASE WHEN f.value_json IS NULL THEN 'default' ELSE 'persisted' END AS origin
    FROM defaults d LEFT JOIN fin f USING (key))"""

_WS_SQL = "'^\\s+|\\s+$'"
_RED = _redact_sql("text")

ORACLE.update({
    "response_class": f"""{HTTP}
SELECT event_id, status, response_class,
       CASE response_class WHEN 'blocked' THEN 'UpstreamBlockedError' WHEN 'rate_limited' THEN 'RateLimitedError'
                           WHEN 'temporary' THEN 'UpstreamSchemaOrTemporaryError' END AS error_type,
       CAST(CASE response_class WHEN 'blocked' THEN 20 WHEN 'rate_limited' THEN 21 WHEN 'temporary' THEN 30
                                ELSE 0 END AS INTEGER) AS exit_code
  FROM c""",
    "retry_verdict": f"""{HTTP}
SELECT event_id, response_class, attempt_no, retry_cap,
       retry_cap IS NOT NULL AND attempt_no < retry_cap AS retry,
       retry_cap IS NOT NULL AND attempt_no >= retry_cap AS exhausted,
       CASE WHEN retry_cap IS NOT NULL AND attempt_no < retry_cap THEN
            CASE response_class WHEN 'rate_limited' THEN 120.0 WHEN 'temporary' THEN 30.0 * pow(2, attempt_no - 1) * 0.8 END
       END::DOUBLE AS backoff_min_s,
       CASE WHEN retry_cap IS NOT NULL AND attempt_no < retry_cap THEN
            CASE response_class WHEN 'rate_limited' THEN 300.0 WHEN 'temporary' THEN 30.0 * pow(2, attempt_no - 1) * 1.2 END
       END::DOUBLE AS backoff_max_s
  FROM cc""",
    "attempt_rollup": f"""{HTTP},
x AS (SELECT *, retry_cap IS NULL OR attempt_no >= retry_cap AS ends FROM cc)
SELECT run_id, query, count(*) AS attempts_logged, max(attempt_no) AS max_attempt_no,
       min(attempt_no) FILTER (WHERE ends) AS ending_attempt,
       CASE WHEN count(*) FILTER (WHERE ends) = 0 THEN 'pending'
            WHEN arg_min(response_class, attempt_no * 1000000 + event_id) FILTER (WHERE ends) IN ('ok', 'passed')
              THEN 'success'
            ELSE arg_min(response_class, attempt_no * 1000000 + event_id) FILTER (WHERE ends) END AS outcome,
       arg_max(response_class, attempt_no * 1000000 + event_id) AS last_class
  FROM x GROUP BY run_id, query""",
    "redacted_text": f"""WITH r AS (SELECT doc_id, text, {_RED} AS red FROM documents),
s AS (SELECT *, regexp_replace(red, {_WS_SQL}, '', 'g') AS st FROM r)
SELECT doc_id, red <> text AS changed, sha256(red) AS redacted_sha256,
       CASE WHEN st = '' THEN 'unexpected runtime failure'
            WHEN length(st) <= 200 THEN st
            ELSE regexp_replace(left(st, 200), '\\s+$', '', 'g') || '...' END AS short_message
  FROM s""",
    "collection_plan": """WITH l AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [lower(c_mktsegment), c_name] END AS items FROM customer),
q AS (
  SELECT c_custkey, i - 1 AS query_pos, items[i] AS query FROM l, range(1, len(items) + 1) t(i)
  UNION ALL SELECT c_custkey, 0, NULL FROM l WHERE len(items) = 0)
SELECT c_custkey, CAST(query_pos AS INTEGER) AS query_pos, query, CAST(p AS INTEGER) AS page,
       CAST(p * 50 AS INTEGER) AS "offset", 50 AS count
  FROM q, range(0, 5) t(p)""",
    "run_totals": f"{RUNS} SELECT * FROM tot",
    "run_current_state": f"{RUNS} SELECT * FROM runs",
    "latest_run": f"{RUNS} SELECT * FROM latest",
    "recent_runs": f"{RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 5",
    "recent_results": f"""{RUNS}
SELECT * FROM rres WHERE run_id = (SELECT run_id FROM latest) ORDER BY started_at DESC, id DESC LIMIT 5""",
    "failed_run_probe": f"""{RUNS}
SELECT run_id, started_at, error_type FROM runs
 WHERE trigger = 'worker_interval' AND status = 'failed' AND error_type = 'UpstreamSchemaOrTemporaryError'
 ORDER BY started_at DESC, run_id DESC LIMIT 1""",
    "command_state": f"""{CMDS}
SELECT command_id, command_type, payload_json, status, created_at, started_at, finished_at, requested_by, result_json,
       error_type, redacted_error FROM cs""",
    "command_fifo": f"""{CMDS}
SELECT command_id, created_at FROM cs WHERE status = 'queued' ORDER BY created_at, command_id LIMIT 1""",
    "recent_commands": f"""{CMDS}
SELECT command_id, command_type, payload_json, status, created_at, started_at, finished_at, requested_by, result_json,
       error_type, redacted_error
  FROM cs ORDER BY created_at DESC, command_id DESC LIMIT 5""",
    "config_validation": f"{CFG} SELECT seq, key, error FROM val",
    "config_current": f"{CFG} SELECT * FROM cur",
    "config_seeded": f"""{CFG}, {DEFAULTS},
sc AS (SELECT DISTINCT scope FROM cfg),
base AS (SELECT sc.scope, d.key, d.default_json FROM sc, defaults d)
SELECT coalesce(b.scope, c.scope) AS scope, coalesce(b.key, c.key) AS key,
       coalesce(c.value_json, b.default_json) AS value_json,
       CASE WHEN c.value_json IS NULL THEN 'default' ELSE 'persisted' END AS origin
  FROM base b FULL OUTER JOIN cur c ON b.scope = c.scope AND b.key = c.key""",
    "config_after_commands": f"{AFTER} SELECT * FROM wcfg",
    "status_document": RUNS + ",\n" + AFTER[len(EV):].lstrip(",\n") + f""",
rr AS (SELECT string_agg(run_id, ',' ORDER BY started_at DESC, run_id DESC) AS t
         FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 5) x),
rs AS (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY started_at DESC, id DESC) AS t
         FROM (SELECT * FROM rres WHERE run_id = (SELECT run_id FROM latest)
                ORDER BY started_at DESC, id DESC LIMIT 5) x),
rc AS (SELECT string_agg(command_id, ',' ORDER BY created_at DESC, command_id DESC) AS t
         FROM (SELECT * FROM cs ORDER BY created_at DESC, command_id DESC LIMIT 5) x),
kv AS (SELECT string_agg(key || '=' || value_json, ',' ORDER BY key || '=' || value_json) AS t FROM wcfg)
SELECT coalesce((SELECT status FROM latest), 'empty') AS status, (SELECT run_id FROM latest) AS last_run_id,
       (SELECT t FROM rr) AS recent_runs, (SELECT t FROM rs) AS recent_results,
       (SELECT t FROM rc) AS recent_commands, (SELECT t FROM kv) AS config""",
})


# ----------------------------------------------------------------- streaming

ORACLE.update({
    "stream_insert_if_new": ORACLE["two_batch_first_wins"],
    "stream_ledger": f"""{BATCHES},
seen AS (SELECT batch_id, count(*) AS seen FROM allv GROUP BY batch_id),
ins AS (SELECT batch_id, count(*) AS inserted FROM win GROUP BY batch_id),
rej AS (SELECT batch_id, count(*) AS rejected FROM allr WHERE fault = 'malformed' OR reason IS NOT NULL GROUP BY batch_id)
SELECT s.batch_id, s.seen, coalesce(i.inserted, 0) AS inserted, s.seen - coalesce(i.inserted, 0) AS skipped,
       coalesce(j.rejected, 0) AS rejected
  FROM seen s LEFT JOIN ins i USING (batch_id) LEFT JOIN rej j USING (batch_id)""",
    "stream_command_state": ORACLE["command_state"],
})
ORACLE["stream_watermark_dedupe"] = ORACLE["stream_ledger"]


# ---------------------------------------------------------- scheduled run

SCHED = """WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
q AS (
  SELECT 0 AS id, 'q_even' AS query, (SELECT sum(n) FROM t WHERE conv_id % 2 = 0) AS seen,
         (SELECT sum(n) FROM t WHERE conv_id % 2 = 0) AS inserted
  UNION ALL SELECT 1, 'q_odd', (SELECT sum(n) FROM t WHERE conv_id % 2 = 1), (SELECT sum(n) FROM t WHERE conv_id % 2 = 1)
  UNION ALL SELECT 2, 'q_again', (SELECT sum(n) FROM t), 0)"""

ORACLE.update({
    "scheduled_run_results": SCHED + """
SELECT CAST(id AS BIGINT) AS id, query, 'success' AS status, CAST(seen AS BIGINT) AS seen_count,
       CAST(inserted AS BIGINT) AS inserted_count, CAST(seen - inserted AS BIGINT) AS skipped_count,
       NULL::VARCHAR AS error_type, NULL::VARCHAR AS redacted_error FROM q
UNION ALL SELECT 3, 'q_missing', 'failed', 0, 0, 0, 'CollectorError', 'live collection returned zero jobs'""",
    "scheduled_run_state": SCHED + """
SELECT 'run-0001' AS run_id, '2024-01-01T00:00:00Z' AS started_at, '2024-01-01T00:00:00Z' AS finished_at,
       CAST(0 AS BIGINT) AS duration_seconds, 'failed' AS status, 'scheduled' AS trigger, CAST(4 AS BIGINT) AS query_count,
       CAST((SELECT sum(seen) FROM q) AS BIGINT) AS total_seen, CAST((SELECT sum(inserted) FROM q) AS BIGINT) AS total_inserted,
       CAST((SELECT sum(seen - inserted) FROM q) AS BIGINT) AS total_skipped,
       'CollectorError' AS error_type, 'live collection returned zero jobs' AS redacted_error""",
})


# ------------------------------------------------ whole-file responses, S8

ORACLE.update({
    "fixture_audit": f"""{ENV}
SELECT a.conv_id, a.audit_class, r.error FROM aud a JOIN rerr r USING (line_no)""",
    "recent_envelope": f"""
SELECT true AS ok, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(count(*) AS INTEGER) AS n_rows,
       coalesce(string_agg(concat_ws('|', job_id, title, url, skills, first_seen_at), ';' ORDER BY first_seen_at DESC, job_id), '') AS content
  FROM ({ORACLE['recent']}) x""",
    "get_missing_envelope": "SELECT false AS ok, 'not_found' AS error, 'no-such-job' AS job_id",
})


ORACLE.update({
    "command_vocabulary": f"""{CMDS}
SELECT command_id, seq, command_type IN ('run_once', 'pause', 'resume', 'update_config') AS type_ok,
       status IN ('queued', 'running', 'applied', 'failed') AS status_ok FROM ce""",
    "command_status_one": f"""{CMDS}
SELECT command_id, command_type, payload_json, status, created_at, started_at, finished_at, requested_by, result_json,
       error_type, redacted_error
  FROM cs WHERE command_id = 'cmd-000007'""",
})


ORACLE.update({
    "strict_first_error": f"""{RAW},
bad AS (
  SELECT line_no, CASE WHEN fault = 'malformed' THEN 'malformed JSONL at line ' || line_no
                       ELSE 'invalid collector record at line ' || line_no || ': ' || reason END AS message
    FROM r WHERE fault = 'malformed' OR reason IS NOT NULL)
SELECT (SELECT count(*) FROM v) AS seen, (SELECT count(*) FROM bad) AS rejected,
       (SELECT arg_min(message, line_no) FROM bad) AS first_error""",
})


# ------------------------------------------------- reads on an ingested store


def _store_page(where: str) -> str:
    return f"""{RAW},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line_no) AS rn FROM v) x WHERE rn = 1),
page AS (SELECT w.* FROM w JOIN cks USING (line_no) {where} ORDER BY rid LIMIT 20)
SELECT p.rid AS job_id, p.title_s AS title, '{URL_PREFIX}' || p.rid AS url, c.skills, p.hourly_min, p.fixed_amount,
       CAST(p.doc_id AS VARCHAR) AS raw_id, '2024-01-01T00:00:00Z' AS first_seen_at
  FROM page p JOIN (SELECT line_no, string_agg(skill, ',' ORDER BY skill) AS skills FROM ck GROUP BY line_no) c
       USING (line_no)"""


ORACLE.update({
    "store_recent": _store_page(""),
    "store_search": _store_page(
        "WHERE lower(w.title_s) LIKE '%the%' AND EXISTS (SELECT 1 FROM ck WHERE ck.line_no = w.line_no AND ck.skill = 'en')"),
})

WON = f"""{RAW},
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY line_no) AS rn FROM v) x WHERE rn = 1)"""

ORACLE.update({
    "store_get": f"""{WON}
SELECT p.rid AS job_id, p.title_s AS title, '{URL_PREFIX}' || p.rid AS url, c.skills, p.hourly_min, p.fixed_amount,
       CAST(p.doc_id AS VARCHAR) AS raw_id, '2024-01-01T00:00:00Z' AS first_seen_at
  FROM (SELECT * FROM w ORDER BY rid LIMIT 1) p
  JOIN (SELECT line_no, string_agg(skill, ',' ORDER BY skill) AS skills FROM ck GROUP BY line_no) c USING (line_no)""",
    "store_summary": f"{WON} SELECT (SELECT count(*) FROM w) AS jobs, (SELECT count(*) FROM ck JOIN w USING (line_no)) AS skills",
    "store_skills": f"{WON} SELECT ck.skill, count(*) AS count FROM ck JOIN w USING (line_no) GROUP BY 1",
    "store_budgets": f"""{WON}
SELECT CASE WHEN fixed_amount IS NOT NULL THEN 'fixed' WHEN hourly_min IS NOT NULL THEN 'hourly'
            ELSE 'unknown' END AS budget_type, count(*) AS count, min(hourly_min) AS min_hourly_min,
       NULL::DOUBLE AS max_hourly_max, min(fixed_amount) AS min_fixed_amount, max(fixed_amount) AS max_fixed_amount
  FROM w GROUP BY 1""",
    "readiness_verdict": """
SELECT 'missing' AS store, false AS ok, 'db_missing' AS reason, 'database file does not exist' AS details
UNION ALL SELECT 'partial', false, 'schema_missing', 'runtime schema is missing required tables'
UNION ALL SELECT 'newer', false, 'unsupported_schema', 'database schema version is newer than this build supports'
UNION ALL SELECT 'unseeded', false, 'config_empty', 'no collector config rows'
UNION ALL SELECT 'full', count(*) > 0, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'config_empty' END,
                 CASE WHEN count(*) = 0 THEN 'no collector config rows' END FROM events""",
    "redaction_cases": f"""WITH c AS (
  SELECT doc_id, kind, CASE kind
    WHEN 0 THEN '{{"token": "S' || doc_id || '"}} end'
    WHEN 1 THEN 'Cookie: a=S' || doc_id || '; b=S' || doc_id || chr(10) || 'end'
    WHEN 2 THEN 'Authorization: Basic S' || doc_id || chr(10) || 'end'
    WHEN 3 THEN 'secret_key=S' || doc_id || ' end'
    WHEN 4 THEN 'tokens=S' || doc_id || '; end' END AS t
    FROM documents, range(5) k(kind))
SELECT doc_id, CAST(kind AS INTEGER) AS kind, {_redact_sql('t')} AS redacted, contains({_redact_sql('t')}, 'S' || doc_id) AS leaks FROM c""",
    "crash_then_duplicate": f"""{BATCHES}
SELECT (SELECT count(DISTINCT rid) FROM b1_v) AS stored, CAST(0 AS BIGINT) AS inserted_after, CAST(2 AS BIGINT) AS batch_id""",
})

ORACLE.update({
    "results_of_a_run": f"""{RUNS}
SELECT * FROM rres WHERE run_id = (SELECT min(run_id) FROM rres) ORDER BY started_at DESC, id DESC LIMIT 5""",
    "results_of_all_runs": f"{RUNS} SELECT * FROM rres ORDER BY started_at DESC, id DESC LIMIT 100",
    "settings_parse": """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS BIGINT) END AS pages,
       CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true END AS paused
  FROM customer""",
    "command_log_mixed_writers": ORACLE["command_state"],
    "stream_after_batch": ORACLE["two_batch_first_wins"],
})


# ------------------------------------------------------------ command drain

DRAIN = AFTER + """,
pend AS (
  SELECT *, row_number() OVER (ORDER BY created_at, command_id) AS position,
         CASE WHEN command_type = 'update_config' AND first_k % 7 = 0 THEN 'unsupported config keys: bogus' END AS error
    FROM cs WHERE status IN ('queued', 'running')),
folded AS (
  SELECT *, last_value(CASE command_type WHEN 'pause' THEN 'true' WHEN 'resume' THEN 'false' END IGNORE NULLS)
              OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paused,
         last_value(CASE WHEN command_type = 'update_config' AND error IS NULL THEN CAST(first_k % 5 + 1 AS VARCHAR) END IGNORE NULLS)
              OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pages
    FROM pend),
plan AS (
  SELECT command_id, position, command_type, status AS was, created_at, payload_json, error,
         CASE WHEN command_type = 'run_once' THEN 'run' WHEN error IS NULL THEN 'applied' ELSE 'failed' END AS outcome,
         '{"interval_seconds":3600,"max_pages":' || coalesce(pages, (SELECT value_json FROM wcfg WHERE key = 'max_pages'))
           || ',"page_size":50,"paused":' || coalesce(paused, (SELECT value_json FROM wcfg WHERE key = 'paused'))
           || ',"queries":[]}' AS config_json
    FROM folded)"""

ORACLE.update({
    "command_fifo_drain": f"{DRAIN} SELECT command_id, position, command_type, outcome, error, config_json FROM plan",
    "command_status_after_drain": f"""{DRAIN}
SELECT cs.command_id, cs.command_type, cs.payload_json,
       CASE WHEN p.outcome IS NULL OR p.outcome = 'run' THEN cs.status ELSE p.outcome END AS status, cs.created_at,
       CASE WHEN p.outcome IS NULL OR p.outcome = 'run' THEN cs.started_at ELSE coalesce(cs.started_at, '2030-01-01T00:00:00Z') END AS started_at,
       CASE WHEN p.outcome IS NULL OR p.outcome = 'run' THEN cs.finished_at
            ELSE coalesce(cs.finished_at, '2030-01-01T00:00:00Z') END AS finished_at,
       cs.requested_by,
       CASE p.outcome WHEN 'applied' THEN '{{"config":' || p.config_json || '}}' WHEN 'failed' THEN NULL ELSE cs.result_json END AS result_json,
       CASE p.outcome WHEN 'applied' THEN NULL WHEN 'failed' THEN 'ValueError' ELSE cs.error_type END AS error_type,
       CASE p.outcome WHEN 'applied' THEN NULL WHEN 'failed' THEN p.error ELSE cs.redacted_error END AS redacted_error
  FROM cs LEFT JOIN plan p USING (command_id)""",
    "command_recovery": f"""{DRAIN}
SELECT p.command_id, p.position, p.outcome AS status, cs.started_at, coalesce(cs.finished_at, '2030-01-01T00:00:00Z') AS finished_at,
       CASE p.outcome WHEN 'failed' THEN 'ValueError' END AS error_type
  FROM plan p JOIN cs USING (command_id) WHERE p.was = 'running' AND p.outcome <> 'run'""",
})


# ------------------------------------------------- canonical text, folding

ORACLE.update({
    "raw_content_hash": f"""{RAW}
SELECT line_no, sha256('{{"description":' || to_json(text)
  || coalesce(',"fixed_amount":' || CAST(fixed_amount AS VARCHAR), '')
  || CASE WHEN n_chars % 3 = 1 THEN ',"hourly_min":' || CAST(n_chars % 100 AS VARCHAR) ELSE '' END
  || ',"id":"' || rid || '","raw_id":"' || doc_id || '","skills":' || to_json([lang, ' ' || source || '  x ', upper(lang)])
  || ',"source":"{SOURCE}","title":' || to_json('  ' || left(text, 40)) || ',"url":"{URL_PREFIX}' || rid || '"}}') AS content_hash
  FROM v""",
    "canonical_nested": """
SELECT doc_id, sha256('{"A":"ß\\u000b","doc":' || doc_id || ',"z":{"a":[true,null,{"t":' || to_json(left(text, 60)) || '}],"b":' || n_chars
  || '},"é":[' || CAST(n_chars / 4 AS VARCHAR) || ',' || n_chars || '.5,[],{}]}') AS canonical_sha256
  FROM documents""",
    "skill_casefold": """
SELECT doc_id AS line_no, 'x' || list_extract(['ss', 'ss', 's', 'σ', 'i̇', 'ffi', 'ǆ', 'σ', 'a'], doc_id % 9 + 1)
       || ' ' || lower(source) AS skill
  FROM documents""",
})


# ------------------------------------------- compaction, pages, through the API

PAGES = """WITH cv AS (
  SELECT 'q' || CAST(conv_id % 10 AS VARCHAR) AS query, conv_id % 10 AS k, CAST((conv_id // 10) % 4 AS INTEGER) AS page, conv_id
    FROM conversations),
pl AS (
  SELECT CAST(k AS BIGINT) AS list, name || CAST(k AS VARCHAR) AS query, CAST(p AS INTEGER) AS page
    FROM (SELECT DISTINCT k FROM cv) x, (VALUES ('q'), ('never')) n(name), range(3) r(p)),
lp AS (SELECT DISTINCT query, page FROM cv),
jp AS (SELECT pl.*, lp.query IS NOT NULL AS landed FROM pl LEFT JOIN lp ON lp.query = pl.query AND lp.page = pl.page)"""
CLEAN = ENV.split("CASE WHEN conv_id % 13")[0] + "NULL::VARCHAR AS fault" + ENV.split("END AS fault", 1)[1]

ORACLE.update({
    "store_after_compaction": ORACLE["two_batch_first_wins"],
    "planned_pages": f"{PAGES} SELECT list, query, page, landed FROM jp",
    "missing_pages": f'{PAGES} SELECT list, query, page, page * 50 AS "offset" FROM jp WHERE NOT landed',
    "planned_run_results": f"""{PAGES}
SELECT CAST(id AS BIGINT) AS id, query, 'success' AS status, n AS seen_count, CASE WHEN id < 2 THEN n ELSE 0 END AS inserted_count
  FROM (VALUES (0, 'q1'), (1, 'q2'), (2, 'q1')) t(id, query)
  JOIN (SELECT query, count(*) AS n FROM cv WHERE page < 2 GROUP BY query) USING (query)""",
    "command_stream_replay": f"{CMDS} SELECT status, count(*) AS events FROM ce GROUP BY status",
    "api_recent": ORACLE["store_recent"],
    "api_get": ORACLE["store_get"],
    "api_summary": ORACLE["store_summary"],
    "api_search_casefold": """
SELECT CAST(doc_id AS VARCHAR) AS job_id, 'strasse' AS skills FROM documents WHERE doc_id % 3 < 2 ORDER BY 1 LIMIT 20""",
    "api_run_status": """
SELECT 'failed' AS status, 'run-0001' AS last_run_id, '3,2,1,0' AS recent_results,
       'interval_seconds=3600,max_pages=5,page_size=50,paused=false,queries=[]' AS config, 'q_again,q_even,q_odd' AS source_queries
  FROM (SELECT count(*) FROM conversations)""",
    "api_collect_fixture": f"{CLEAN} SELECT job_id, title, url, hourly_min, raw_id FROM rec",
    "command_enqueue": """
SELECT 'cmd-' || r_regionkey AS command_id, 'update_config' AS command_type,
       '{"updates": {"queries": ["' || r_name || '"], "max_pages": ' || (r_regionkey + 1) || '}}' AS payload_json, 'queued' AS status,
       '2024-01-01T00:00:00Z' AS created_at, 'mcp' AS requested_by
  FROM region""",
    "expected_failure": f"""{RUNS}
SELECT t.trigger, e.error_type, CASE e.error_type WHEN 'CollectorError' THEN true
         WHEN 'ValueError' THEN EXISTS (SELECT 1 FROM runs WHERE runs.trigger = t.trigger AND runs.status = 'failed') ELSE false END AS expected
  FROM (VALUES ('scheduled'), ('worker_interval'), ('mcp_run_once'), ('other')) t(trigger),
       (VALUES ('CollectorError'), ('RecordValidationError'), ('ValueError'), ('TypeError')) e(error_type)""",
    "exit_codes": """WITH c AS (SELECT [('CollectorError', 30), ('CredentialRequiredError', 10), ('InputPathError', 2),
  ('InternalFailureError', 40), ('RateLimitedError', 21), ('RecordValidationError', 30), ('UpstreamBlockedError', 20),
  ('UpstreamSchemaOrTemporaryError', 30), ('UsageError', 2), ('ValidationError', 30), ('KeyError', 40), (NULL, 0)] AS t)
SELECT event_id, t[event_id % 12 + 1][1] AS error_type, t[event_id % 12 + 1][2] AS exit_code FROM events, c""",
    "input_glob": ORACLE["jsonl_parse_status"],
    "stream_interval": f"{BATCHES} SELECT rid AS job_id, CAST(doc_id AS VARCHAR) AS raw_id FROM win",
    "stream_strict_failure": f"""{RAW}
SELECT CAST(1 AS BIGINT) AS batch_id, 'failed' AS status, 'RecordValidationError' AS error_type, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS inserted
UNION ALL SELECT 2, 'success', NULL, (SELECT count(*) FROM v), (SELECT count(DISTINCT rid) FROM v)""",
})
