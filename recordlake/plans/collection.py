"""Collection plan: configured query lists × pages.

Each input row holds one comma-separated query list. Items are split, stripped
and blank ones dropped (X14); a list with no items stands for one unfiltered
query (X15, NULL). Pages come from ``explode(sequence(0, max_pages - 1))`` on
each query row — a generator per row, not a join.

Landed pages are found from paths alone (``query=<name>/page=<n>/``), without opening
a file, and joined to the plan: what was planned, what is there, what never landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.text import comma_list


def collection_plan(lists: DataFrame, list_key: str, text: str, max_pages: int = 5, page_size: int = 50) -> DataFrame:
    if max_pages < 1 or page_size < 1:
        raise ValueError("max_pages and page_size must be positive integers")
    items = comma_list(text)
    queries = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(None).cast("string")))
    q = lists.select(list_key, F.posexplode(queries).alias("query_pos", "query"))
    return q.select(
        list_key, "query_pos", "query",
        F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("page"),
    ).select(
        list_key, "query_pos", "query", "page",
        (F.col("page") * page_size).alias("offset"), F.lit(page_size).alias("count"),
    )


#: The folder of the unfiltered query.
UNFILTERED = "__all__"


def query_folder(query: str | None) -> str:
    return f"query={UNFILTERED if query is None else query}"


def landed_pages(spark: SparkSession, landing: str) -> DataFrame:
    """S3: ``(query, page, files, bytes)`` of the page folders below ``landing``. The listing is Spark's; no
    file's content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing).select("path", "length")
    name = F.regexp_extract("path", r"/query=([^/]+)/page=\d+/", 1)
    pages = files.where(name != "").select(
        F.nullif(name, F.lit(UNFILTERED)).alias("query"),
        F.regexp_extract("path", r"/page=(\d+)/", 1).cast("int").alias("page"), "length")
    return pages.groupBy("query", "page").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def planned_pages(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Every planned page with ``landed`` and its files and bytes (0 without any)."""
    there = landed.select(F.col("query").alias("_q"), F.col("page").alias("_p"), "files", "bytes")
    j = plan.join(there, plan["query"].eqNullSafe(F.col("_q")) & (plan["page"] == F.col("_p")), "left")
    return j.select(*plan.columns, F.col("files").isNotNull().alias("landed"), F.coalesce("files", F.lit(0)).alias("files"),
                    F.coalesce("bytes", F.lit(0)).alias("bytes"))


def missing_pages(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Planned pages that never landed."""
    there = landed.select(F.col("query").alias("_q"), F.col("page").alias("_p"))
    return plan.join(there, plan["query"].eqNullSafe(F.col("_q")) & (plan["page"] == F.col("_p")), "left_anti")
