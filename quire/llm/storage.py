"""Where operators of this subpackage keep what several jobs read.

Executors and driver share no local folder, so lineage is cut in the folder that the cluster names
in ``spark.checkpoint.dir``.  Where that is unset, local mode (tests) uses a temporary one; a cluster
is refused.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; it is also made the session's checkpoint folder where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        base = named.rstrip("/")
    else:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='quire-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"


def free(taken, name: str) -> str:
    """``name``, with underscores at its end while ``taken`` has it in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Runs ``df`` into a Parquet table of the shared folder; returns it as read back, and its path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a stored table of short fixed-size columns, marked for a broadcast if it has at most ``rows``
    rows; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def with_group_min(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` and the smallest ``value`` of each row's ``key``.  The minima are a stored table, so that the
    join is of two plain shuffles and adaptive execution can split a frequent key."""
    least, _ = write_table(df.groupBy(key).agg(F.min(value).alias(name)), "least")
    return df.join(least, key)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after another, from batches that are sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        at = 0
        for cut in cuts:
            if rest and rest[-1].column(key)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(at, cut - at))
            at = cut
    if rest:
        yield pa.Table.from_batches(rest)
