"""Readers. Connection data comes from the caller, never from this code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MALFORMED = "_malformed"


@dataclass(frozen=True)
class Jdbc:
    """A relational source: a whole table, or the rows of a query.

    Reads are split by ``partition_column`` with bounds. For a small table that
    may come through one connection, say ``unsplit=True``.
    """

    url: str
    table: str | None = None
    query: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    lower_bound: object = None
    upper_bound: object = None
    num_partitions: int = 32
    fetch_size: int = 10_000
    unsplit: bool = False

    def options(self) -> dict[str, str]:
        if (self.table is None) == (self.query is None):
            raise ValueError("name either a table or a query")
        if self.unsplit != (self.partition_column is None):
            raise ValueError("name a partition column and its bounds, or ask for an unsplit read")
        opts = {"url": self.url, "fetchsize": str(self.fetch_size), **self.properties}
        if self.partition_column is None:
            opts |= {"dbtable": self.table} if self.table else {"query": self.query}
        else:
            # Spark splits only dbtable reads, so a query goes in as a subquery.
            opts["dbtable"] = self.table or f"({self.query}) AS extract"
            opts |= {
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower_bound),
                "upperBound": str(self.upper_bound),
                "numPartitions": str(self.num_partitions),
            }
        return opts

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).load()


@dataclass(frozen=True)
class Csv:
    """A CSV extract with a header. Latin-1 files: ``encoding="ISO-8859-1"``.

    Quotes inside quoted cells are doubled. With a schema the file is read once, and a
    header with other names or another order is an error; without one all columns are text.

    Cells with line breaks need ``multi_line=True``. Spark then reads each file in one
    task, so such extracts should come as many files.
    """

    path: str
    schema: T.StructType | str | None = None
    encoding: str = "UTF-8"
    multi_line: bool = False

    def _reader(self, spark: SparkSession) -> DataFrameReader:
        return spark.read.options(
            header=True, encoding=self.encoding, quote='"', escape='"', enforceSchema=False, multiLine=self.multi_line
        )

    def read(self, spark: SparkSession) -> DataFrame:
        reader = self._reader(spark)
        return (reader.schema(self.schema) if self.schema else reader).csv(self.path)

    def read_marked(self, spark: SparkSession) -> DataFrame:
        """The rows with ``_malformed``: the line, where a cell is not of the schema's type or there are too few or
        too many cells; else null. All cells are read, whatever columns are asked for."""
        if not self.schema:
            raise ValueError("only rows of a declared schema can be malformed")
        kinds = T.StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        marked = T.StructType([*kinds.fields, T.StructField(MALFORMED, T.StringType())])
        reader = self._reader(spark).schema(marked).option("columnNameOfCorruptRecord", MALFORMED)
        return reader.option("columnPruning", False).csv(self.path)

    def malformed_rows(self, spark: SparkSession) -> int:
        return (marked := self.read_marked(spark)).agg(count_malformed(marked)).first()[0] if self.schema else 0


def count_malformed(marked: DataFrame) -> Column:
    """Aggregate over the rows of ``read_marked``. Spark refuses to read the marker alone, so another column goes with it."""
    return F.count(F.when(F.col(MALFORMED).isNotNull(), F.struct(MALFORMED, marked.columns[0])))


@dataclass(frozen=True)
class Parquet:
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


@dataclass(frozen=True)
class Table:
    """A table of the session's catalogue."""

    name: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


Source = Jdbc | Csv | Parquet | Table


def ingest(spark: SparkSession, sources: Mapping[str, Source], *, save: bool = True) -> dict[str, DataFrame]:
    """Read each named source and, by default, save it as a table of that name."""
    from caretally.sources.sinks import save_table

    frames = {name: source.read(spark) for name, source in sources.items()}
    return {name: save_table(df, name) for name, df in frames.items()} if save else frames


def copy_table(spark: SparkSession, source: Source, name: str) -> DataFrame:
    return ingest(spark, {name: source})[name]


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Each table of a database with its columns as one text. Reads metadata only."""
    rows = [
        (t.name, ", ".join(c.name for c in spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name)))
        for t in spark.catalog.listTables(database)
    ]
    return spark.createDataFrame(rows, "table_name string, column_names string")
