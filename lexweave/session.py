"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Tables written by this process and not yet removed.
_staged: list[str] = []
# Those of them that the catalog knows.
_named: list[str] = []


def get_session(
    app_name: str = "lexweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with adaptive execution on; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A local session may do without the setting. On a cluster a missing one is an error: executors
    would write to disks that others cannot read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lexweave-ckpt-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written files.

    Unlike ``checkpoint()`` this computes the plan once, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(parts: Sequence[DataFrame], keys: Sequence[str], buckets: int) -> DataFrame:
    """``parts``, of one schema, as one table in the shared folder, in hash buckets of ``keys``.

    A join or grouping on ``keys`` (or on more columns than these) reads it without a shuffle. A part that
    is not yet dealt over ``buckets`` by its keys is to be repartitioned by the caller.
    """
    spark = parts[0].sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    for number, part in enumerate(parts):
        writer = part.write.mode("append" if number else "errorifexists").bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", path).saveAsTable(name)
    _staged.append(path)
    _named.append(name)
    return spark.table(name)


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables written here in this process; call it when a job has ended."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
