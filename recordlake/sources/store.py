"""Record store catalogue: schema version, table presence and readiness.

Readiness is decided from folder metadata and one tiny version row, never by
scanning data, and a read never creates anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.operators.control import READINESS_SCHEMA, readiness
from recordlake.schemas import SCHEMA_VERSION
from recordlake.session import list_dirs, path_exists
from recordlake.sources.snapshots import current, read_log

BASE_TABLES = {"jobs", "job_skills", "run_events", "run_results"}
CONTROL_TABLES = {"config_events", "command_events"}
META = T.StructType([T.StructField("schema_version", T.IntegerType())])
#: Any version of the config log has this column.
CONFIG_ROW = T.StructType([T.StructField("key", T.StringType())])
FOLDING = T.StructType([T.StructField("exact_casefold", T.BooleanType())])


def _table_schemas() -> dict[str, T.StructType]:
    from recordlake.operators.ingest import STORE_JOBS, STORE_SKILLS
    from recordlake.schemas import COMMAND_EVENTS, CONFIG_EVENTS, RUN_EVENTS, RUN_RESULTS

    return {"jobs": STORE_JOBS, "job_skills": STORE_SKILLS, "run_events": RUN_EVENTS, "run_results": RUN_RESULTS,
            "config_events": CONFIG_EVENTS, "command_events": COMMAND_EVENTS}


def init_store(spark: SparkSession, root: str, version: int = SCHEMA_VERSION, tables: bool = True) -> None:
    """Write the version marker and create every missing table empty (idempotent)."""
    spark.createDataFrame([(version,)], META).coalesce(1).write.mode("overwrite").parquet(f"{root}/_meta")
    if not tables:
        return
    for name, schema in _table_schemas().items():
        if not path_exists(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


def folding(spark: SparkSession, root: str) -> bool:
    """Whether the store's skills are folded by exact ``casefold``, which is the default, or by ``lower``, as in
    filled stores from before the mode was written down."""
    path = f"{root}/_folding"
    if path_exists(spark, path):
        return bool(spark.read.schema(FOLDING).parquet(path).first()["exact_casefold"])
    return not (path_exists(spark, f"{root}/batches") or current(spark, root).segments)


def settle_folding(spark: SparkSession, root: str, wanted: bool | None = None) -> bool:
    """The store's folding mode; a store keeps the mode of its first ingest, and another is an error."""
    mode, marked = folding(spark, root), path_exists(spark, f"{root}/_folding")
    if wanted is not None and wanted != mode:
        if marked or not mode:
            raise ValueError(f"the store folds skills with exact_casefold={mode}")
        mode = wanted
    if not marked:
        spark.createDataFrame([(mode,)], FOLDING).coalesce(1).write.mode("overwrite").parquet(f"{root}/_folding")
    return mode


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(f"{root}/{name}")


def schema_version(spark: SparkSession, root: str) -> int | None:
    if not path_exists(spark, f"{root}/_meta"):
        return None
    row = spark.read.schema(META).parquet(f"{root}/_meta").agg(F.max("schema_version")).first()
    return None if row is None else row[0]


def present_tables(spark: SparkSession, root: str) -> set[str]:
    compacted = {t for s in current(spark, root).segments for t in s.tables}
    return {d for d in list_dirs(spark, root) if not d.startswith("_")} | compacted


def readiness_verdict(spark: SparkSession, root: str, check_config: bool = True) -> dict:
    if not path_exists(spark, root):
        return readiness(set(), None, BASE_TABLES | CONTROL_TABLES, SCHEMA_VERSION)
    tables = present_tables(spark, root)
    version = schema_version(spark, root)
    config_rows = None
    if check_config and "config_events" in tables:
        config_rows = 0 if read_log(spark, root, "config_events", CONFIG_ROW).isEmpty() else 1
    verdict = readiness(tables, version if version is not None else 0, BASE_TABLES | CONTROL_TABLES,
                        SCHEMA_VERSION, config_rows)
    if version is None and not tables:
        verdict = readiness(set(), None, BASE_TABLES | CONTROL_TABLES, SCHEMA_VERSION)
    return verdict


def readiness_table(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    rows = []
    for label, root in roots.items():
        v = readiness_verdict(spark, root)
        rows.append((label, v["ok"], v["reason"], v["details"]))
    return spark.createDataFrame(rows, READINESS_SCHEMA)
