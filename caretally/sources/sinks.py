"""Tables and report files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Replace a table with the rows of a frame that does not read it."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def publish_version(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Replace what a view of this name shows. The rows, which may come from the view
    itself, are written as a new table, and then the view is pointed at it, in one step
    of the catalogue: readers see the old rows or the new ones, and a run that stops on
    the way leaves the old ones. Of the older tables the last stays, for queries that
    still read it."""
    spark = df.sparkSession
    version = f"{name}__v{_next_version(spark, name)}"
    spark.sql(f"DROP TABLE IF EXISTS {version}")  # of a run that stopped on the way
    save_table(df, version, partition_by)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in versions(spark, name)[:-2]:
        drop_table(spark, old)
    return spark.table(name)


def versions(spark: SparkSession, name: str) -> list[str]:
    """The tables behind a view, from the oldest on."""
    database, _, short = name.rpartition(".")
    found = [t.name for t in spark.catalog.listTables(database or None) if t.name.startswith(f"{short.lower()}__v")]
    numbers = sorted(int(t.rpartition("__v")[2]) for t in found if t.rpartition("__v")[2].isdigit())
    return [f"{name}__v{n}" for n in numbers]


def _next_version(spark: SparkSession, name: str) -> int:
    """One beyond the version that the view shows, else beyond the last there is."""
    if spark.catalog.tableExists(name):
        shown = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
        return int(shown.rpartition("__v")[2].split()[0].strip("`;")) + 1
    found = versions(spark, name)
    return int(found[-1].rpartition("__v")[2]) + 1 if found else 1


def rewrite_table(df: DataFrame, name: str) -> DataFrame:
    """Replace a table with rows computed from that same table. They are written
    once, under another name, and then the names are swapped: until the new table
    is whole, the old one stays. Between the two renames there is no table of the name;
    where readers must not see that, keep it as a view, see ``publish_version``."""
    spark = df.sparkSession
    new, old = (f"{name}__{uuid.uuid4().hex[:8]}" for _ in range(2))
    save_table(df, new)
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    drop_table(spark, old)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_report(df: DataFrame, path: str, kind: str = "csv", *, single_file: bool = False) -> None:
    """Write a report folder, CSV with header or Parquet.

    Parts sort by name in row order. ``single_file`` asks for one part, whatever
    its size, which one task writes; it is for reports of some pages.
    """
    if single_file:
        df = df.coalesce(1)
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
