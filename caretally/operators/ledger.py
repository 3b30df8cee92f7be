"""Run metrics taken on the way, while a stage is written, instead of one more scan per stage."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from caretally.session import stage


class Ledger:
    """Collects metrics of stages by name.

    Metrics are plain aggregates over the rows that pass a point of the plan. Distinct
    counts are not among them: count the rows of the table that has one row per key.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, DataFrame, dict[str, Column], Observation]] = []

    def __len__(self) -> int:
        return len(self._seen)

    def watch(self, df: DataFrame, name: str, **wanted: Column) -> DataFrame:
        """The frame, whose rows are measured by the first action that reads it whole;
        ``rows`` may be asked for only after it. Watch next to what is written:
        a task that runs again for another stage counts again."""
        seen = Observation()
        self._seen.append((name, df, wanted, seen))
        return df.observe(seen, *[c.alias(n) for n, c in wanted.items()])

    def stage(self, df: DataFrame, name: str, *, partition_by: tuple[str, ...] = (), **wanted: Column) -> DataFrame:
        """The frame written to the shared folder and read back; measured while it is written."""
        return stage(self.watch(df, name, **wanted) if wanted else df, name, partition_by)

    def values(self) -> dict[tuple[str, str], float | None]:
        """(stage, metric) -> value; waits for actions that have not run.

        Where Spark found out on the way that it need not read a frame at all (the other
        side of its join is empty, say), the frame is read for its metrics alone.
        """
        found = {}
        for name, df, wanted, seen in self._seen:
            try:
                row = seen.get
            except Py4JJavaError:  # no row was observed
                row = df.agg(*[c.alias(n) for n, c in wanted.items()]).first().asDict()
            found |= {(name, m): None if row.get(m) is None else float(row[m]) for m in wanted}
        return found

    def rows(self, spark: SparkSession) -> DataFrame:
        """stage, metric and value: one row per metric."""
        lines = [(name, metric, value) for (name, metric), value in self.values().items()]
        return spark.createDataFrame(lines, "stage string, metric string, value double")
