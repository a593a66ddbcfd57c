import json

from recordlake.operators import normalize as N

PATH_KEYS = ["data", "search", "universalSearchNuxt", "visitorJobSearchV1"]


def envelope(results, paging=True):
    inner = {"results": results}
    if paging:
        inner["paging"] = {"total": len(results), "offset": 0, "count": len(results)}
    out = inner
    for k in reversed(PATH_KEYS):
        out = {k: out}
    return json.dumps(out)


SEARCH = envelope([
    {"id": "1001", "ciphertext": "~01aaa", "title": " Python scraper ", "description": "Scrape it",
     "skills": [{"name": "Python"}, "Web Scraping", " "], "hourlyBudget": {"min": 20, "max": 45.5},
     "jobType": "HOURLY", "postedOn": "2024-05-01T00:00:00Z"},
    {"id": "1002", "cipherText": "~01bbb", "title": "Logo", "snippet": "Design a logo",
     "skills": ["Design"], "fixedPriceBudget": {"amount": 500}, "contractorTier": "EXPERT"},
])
TILE = envelope([
    {"id": "77", "title": "Tile job", "description": "d",
     "ontologySkills": [{"prefLabel": "Go"}],
     "jobTile": {"job": {"ciphertext": "~01tile", "hourlyBudgetMin": "25.0", "hourlyBudgetMax": 45,
                         "fixedPriceAmount": {"amount": "500"}, "publishTime": "2024-06-01", "jobType": "FIXED"}}},
])
MISSING_OPTIONAL = envelope([{"id": "5", "ciphertext": "~01m", "title": "t", "description": "d", "skills": []}])
NUMERIC_ONLY = envelope([{"id": "123", "title": "t", "description": "d"}])
NON_DECIMAL = envelope([{"id": "abc", "title": "t", "description": "d"}])
NO_IDENTITY = envelope([{"title": "t", "description": "d"}])
MALFORMED = json.dumps({"data": {"search": {}}})
ERRORS = json.dumps({"errors": [{"message": "x"}], "data": None})
NOT_LIST = envelope({"a": 1}, paging=False)
ITEM = envelope([5])


def _run(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "rid long, body string")
    norm = N.normalize(df)
    recs = {(r.rid, r.pos): r for r in N.records(norm, ["rid"]).collect()}
    status = {r.rid: (r.status, r.audit_class, r.error) for r in norm.collect()}
    return recs, status


def test_search_response_aliases(spark):
    recs, status = _run(spark, [SEARCH])
    assert status[0][0] == "ok"
    a, b = recs[(0, 0)], recs[(0, 1)]
    assert a.id == "~01aaa" and a.title == "Python scraper" and a.skills == ["Python", "Web Scraping"]
    assert (a.hourly_min, a.hourly_max, a.fixed_amount) == (20.0, 45.5, None)
    assert a.url.endswith("/~01aaa") and a.posted_at == "2024-05-01T00:00:00Z" and a.job_type == "HOURLY"
    assert b.id == "~01bbb" and b.description == "Design a logo" and b.fixed_amount == 500.0
    assert b.contractor_tier == "EXPERT"


def test_job_tile_shape(spark):
    recs, _ = _run(spark, [TILE])
    r = recs[(0, 0)]
    assert r.id == "~01tile" and r.skills == ["Go"]
    assert (r.hourly_min, r.hourly_max, r.fixed_amount) == (25.0, 45.0, 500.0)
    assert r.posted_at == "2024-06-01" and r.job_type == "FIXED" and r.raw_id == "77"


def test_optional_fields_and_numeric_identity(spark):
    recs, _ = _run(spark, [MISSING_OPTIONAL, NUMERIC_ONLY])
    m = recs[(0, 0)]
    assert m.skills == [] and m.posted_at is None and m.hourly_min is None
    assert recs[(1, 0)].id == "~02123"


def test_rejections(spark):
    _, status = _run(spark, [NON_DECIMAL, NO_IDENTITY, MALFORMED, ERRORS, NOT_LIST, ITEM, "not json", "[1]"])
    assert status[0] == ("rejected", "ok", N.ERR_NO_CIPHER)
    assert status[1] == ("rejected", "ok", N.ERR_NO_ID)
    assert status[2] == ("rejected", "path_missing", N.ERR_PATH)
    assert status[3] == ("rejected", "errors_present", N.ERR_ERRORS)
    assert status[4] == ("rejected", "not_list", N.ERR_NOT_LIST)
    assert status[5] == ("rejected", "item_not_object", N.ERR_ITEM)
    assert status[6][1] == "invalid_json" and status[7][1] == "not_object"


def test_empty_errors_list_is_not_an_error(spark):
    body = json.loads(NUMERIC_ONLY)
    body["errors"] = []
    _, status = _run(spark, [json.dumps(body)])
    assert status[0][0] == "ok"


def test_python_float_text(spark):
    df = spark.createDataFrame([(json.dumps({"v": v}),) for v in ["1_000", " 2.5 ", "1e3", "5d", "0x10", "abc", ""]],
                               "j string")
    from pyspark.sql import functions as F
    from recordlake.functions import jsonx as J
    got = [r[0] for r in df.select(N.number(J.parse(F.col("j")), "$.v")).collect()]
    assert got == [1000.0, 2.5, 1000.0, None, None, None, None]
