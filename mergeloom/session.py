"""What the engine needs from a Spark session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows that are held at once, unless the session sets its own: texts can be
#: long. A worker and its task hold an Arrow batch each way, a Parquet scan the
#: texts of a batch of rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}
PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a Spark context, so that
    functions sent to them can be unpickled wherever they run; and bound batches:
    each of ``BATCHES`` that nobody has set is set for the whole session."""
    context = spark.sparkContext
    known = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in known:
            spark.conf.set(key, value)
    if getattr(context, "_mergeloom_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="mergeloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._mergeloom_shipped = True
