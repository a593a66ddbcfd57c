"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import recordlake

# Arrow batches of texts are cut by size, not only by rows.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per application, and bounds
    the session's Arrow batches to ``BATCH_BYTES`` (unless they are smaller already).

    Python functions of the operators are pickled by reference, so a worker
    that starts later (after an executor was lost, too) must find the package:
    files added to the SparkContext reach every executor, new ones included.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(recordlake.__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="recordlake-src-"), "recordlake_src.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
