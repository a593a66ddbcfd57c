"""Session settings and shared scratch locations.

The library never creates a global session. ``configure`` applies the runtime
SQL settings every operator relies on (UTC clock, last-wins duplicate JSON
keys); ``scratch_dir`` hands out a fresh folder under the cluster's shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with repeated keys keep the last value, as Python's json does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "recordlake") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller owns the session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("RECORDLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private one created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="recordlake-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_dir(spark: SparkSession, label: str = "scratch") -> str:
    """A new, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/recordlake-{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Metadata-only existence check through the Hadoop file system."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the library's own (staging) through the Hadoop file system."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (empty when it does not exist)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory())


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files directly in ``path`` (none when it does not exist), hidden ones left out."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(hpath) if s.isFile())
    return sorted(n for n in names if not n.startswith(("_", ".")))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``; 0 when it does not exist."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength()) if fs.exists(hpath) else 0


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file to a name that must not be taken; False when it is (the source then stays)."""
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(dst):
        return False
    fs.mkdirs(dst.getParent())
    return bool(fs.rename(src, dst))


def read_text_file(spark: SparkSession, path: str) -> str:
    """A small file's text, read on the driver through the Hadoop file system."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(hpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that appears whole or not at all; False when its name is taken."""
    folder, name = path.rsplit("/", 1)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(part)
    stream = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(hpath)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if move_new(spark, part, path):
        return True
    delete_path(spark, part)
    return False
