"""Helpers that the corpus operators share: shared-folder tables and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch at most: texts are long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_own_dirs: dict[str, str] = {}


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small, so that an executor's memory does not depend on the texts.

    This sets the session's Arrow limits for good: they are read when a plan runs, which is after this returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``; a temporary one only where unset in local mode (tests)."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="coredust-")
        _own_dirs[app] = found
    return f"{found.rstrip('/')}/coredust-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems (any store that Spark writes to)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucket_prefix_sums(df: DataFrame, group: Sequence[str], bucket: str, values: dict[str, Column], totals: Sequence[str] = ()) -> DataFrame:
    """Per (group, bucket): the sum of each value over the group's *earlier* buckets, named as in ``values``.

    The rows are summed per bucket first (partial aggregation before the shuffle); only those sums, at most
    (groups x buckets) rows, go through the window, so no task ever sorts the rows of a large group.
    ``totals`` names values for which the group's total is added as ``<name>_total``.
    """
    per = df.groupBy(*group, bucket).agg(*(F.sum(v).alias(k) for k, v in values.items()))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in values]
    return per.select(*group, bucket, *out, *(F.sum(k).over(whole).alias(f"{k}_total") for k in totals))
