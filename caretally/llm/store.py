"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from caretally.session import shared_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir (only a local session without the setting gets a folder of its own)."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def table(frame: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder and read back, which cuts its lineage."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


Kind = TypeVar("Kind")


def sent(spark: SparkSession, thing: Kind) -> Callable[[], Kind]:
    """Broadcasts an object together with its class, since executors need no copy of this package (a plain broadcast only names the
    class); the function that it returns gives the object to a task."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(shared.value)
