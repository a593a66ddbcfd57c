"""The store's key index (K1, J3): committed keys in hash buckets.

``job_keys/batch_id=N/attempt=A/lo=L/hi=H/`` holds those keys of a batch whose
hash bucket, out of ``KEY_BUCKETS``, lies in L..H, sorted by bucket. A large batch has a folder
for every bucket, a small one a single folder for all, so that neither files
nor folders are many for their size. A batch's anti join names the buckets of its own
keys in a literal filter on these partition columns (and on the bucket, which
prunes row groups): a small batch opens only what can hold its keys, however
large the store is. Visibility follows the ledger as for the records.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BUCKETS = 256  # fixed: part of the store's layout
FOLDER_BYTES = 8 << 20  # of keys, up to which a batch has one folder
MAX_FILTERED = 64  # buckets that a filter names; a batch that touches more reads all
STORE_KEYS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType()),
    T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
])


def bucket_of(key: str | Column = "job_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def touched_buckets(key: str | Column = "job_id") -> Column:
    """Aggregate: the buckets of a batch's keys, at most ``KEY_BUCKETS`` of them; a null key has none."""
    column = F.col(key) if isinstance(key, str) else key
    return F.sort_array(F.collect_set(F.when(column.isNotNull(), bucket_of(column))))


def in_buckets(keys: DataFrame, buckets: list[int] | None) -> DataFrame:
    """The keys of some buckets, by literal filters; all of them beyond ``MAX_FILTERED``."""
    if buckets is None or len(buckets) > MAX_FILTERED:
        return keys
    if not buckets:
        return keys.where(F.lit(False))
    folder = reduce(or_, ((F.col("lo") <= int(b)) & (F.col("hi") >= int(b)) for b in buckets))
    return keys.where(folder & F.col("bucket").isin([int(b) for b in buckets]))


def folders_for(size: int) -> int:
    """Number of folders for so many bytes of keys: a power of two."""
    n = 1
    while n < KEY_BUCKETS and n * FOLDER_BYTES < size:
        n *= 2
    return n


def write_keys(records: DataFrame, path: str, size: int) -> None:
    """Appends the keys (``size`` bytes) of records that name their batch and attempt."""
    folders = folders_for(size)
    width = KEY_BUCKETS // folders
    bucket = bucket_of()
    rows = records.select("job_id", bucket.alias("bucket"), "batch_id", "attempt",
                          (bucket - bucket % width).alias("lo"), (bucket - bucket % width + (width - 1)).alias("hi"))
    rows = rows.coalesce(1) if folders == 1 else rows.repartition(folders, "lo")
    (rows.sortWithinPartitions("batch_id", "attempt", "lo", "hi", "bucket").write.mode("append")
     .partitionBy("batch_id", "attempt", "lo", "hi").parquet(path))
