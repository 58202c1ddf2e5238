"""Getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows in an Arrow batch, unless the session names a number: rows hold whole texts.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each application, and keeps Arrow
    batches small.

    Spark's file server delivers the package, so workers need not find it on a path of their own."""
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, BATCH_ROWS)
    if getattr(context, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(path)
    context._quire_shipped = True
