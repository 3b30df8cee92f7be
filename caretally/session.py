"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", conf: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caretally")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # Skewed joins are split even where the next step is grouped by the same key.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Recording the call site of every column doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="caretally-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors and, unlike an RDD
    checkpoint, stays columnar: later reads fetch only the columns they use. Filters on
    the columns of ``partition_by`` (flags and the like, with few values) choose whole folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/caretally/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def stage_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Like ``stage``, with the rows dealt to buckets by a hash of the keys, as many as there
    are shuffle partitions. Joins and groupings on these keys then shuffle neither this
    frame nor one staged alike: it pays where several of them follow. A key that is too big
    for one task must not be staged so; see ``skew.hot_keys``.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = uuid.uuid4().hex
    name, path = f"caretally_{label}_{unique}", f"{shared_dir(spark)}/caretally/{label}-{unique}"
    dealt = df.repartition(n, *keys)
    dealt.write.format("parquet").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    staged = spark.table(name).select(*df.columns)
    # The frame knows its files and buckets by now; the catalogue need not keep the name.
    spark.sql(f"DROP TABLE {name}")
    return staged
