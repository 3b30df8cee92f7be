"""Reading, staging and writing."""

import glob

import pytest
from pyspark.sql import functions as F

from caretally import session
from caretally.plans import labs
from caretally.sources import readers, schemas, sinks


def test_jdbc_options():
    table = readers.Jdbc("jdbc:x", table="t", properties={"driver": "d"}, unsplit=True)
    assert table.options() == {"url": "jdbc:x", "fetchsize": "10000", "driver": "d", "dbtable": "t"}
    query = readers.Jdbc("jdbc:x", query="SELECT 1", unsplit=True)
    assert query.options()["query"] == "SELECT 1" and "dbtable" not in query.options()
    split = readers.Jdbc("jdbc:x", query="SELECT 1 AS id", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=4)
    opts = split.options()
    assert opts["dbtable"] == "(SELECT 1 AS id) AS extract" and opts["numPartitions"] == "4" and "query" not in opts
    for bad in (readers.Jdbc("jdbc:x", unsplit=True), readers.Jdbc("jdbc:x", table="t", query="q", unsplit=True), readers.Jdbc("jdbc:x", table="t")):
        with pytest.raises(ValueError):
            bad.options()


def test_latin_1_csv(spark, tmp_path):
    path = tmp_path / "labs.csv"
    row = {c: "" for c in schemas.LAB_COLUMNS} | {
        "EncounterId": "7", "ItemId": "9", "ordPhyName": "Muñoz", "collDate": "Nov  1 2023  9:05AM",
        "ResultDate": "Nov  2 2023  9:05AM", "ReviewedDate": "Jan  1 1901 12:00AM"}
    path.write_bytes((",".join(row) + "\n" + ",".join(row.values()) + "\n").encode("latin-1"))
    raw = readers.Csv(str(path), schemas.LABS, "ISO-8859-1").read(spark)
    assert len(raw.columns) == 70 and raw.schema == schemas.LABS
    got = labs.with_lags(labs.typed_labs(raw), [9]).first()
    assert (got.encounter_id, got.orderer_name, got.result_days, got.reviewed, got.in_house) == (7, "Muñoz", 1, False, True)


def test_schema_widths():
    assert (len(schemas.LAB_COLUMNS), len(schemas.DOCUMENT_COLUMNS)) == (70, 53)


def test_csv_without_schema_is_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,x\n,y\n")
    df = readers.Csv(str(path)).read(spark)
    assert df.dtypes == [("a", "string"), ("b", "string")] and [r.a for r in df.collect()] == ["1", None]


def test_ingest_copy_inventory_drop(spark, tmp_path, as_rows):
    spark.range(5).write.parquet(str(tmp_path / "p"))
    spark.sql("CREATE DATABASE IF NOT EXISTS inv")
    frames = readers.ingest(spark, {"inv.one": readers.Parquet(str(tmp_path / "p"))})
    assert frames["inv.one"].count() == 5
    readers.copy_table(spark, readers.Table("inv.one"), "inv.two")
    sinks.save_table(spark.table("inv.two").withColumn("b", F.lit(1)), "inv.three")
    assert as_rows(readers.catalog_inventory(spark, "inv")) == [("one", "id"), ("three", "id, b"), ("two", "id")]
    sinks.drop_table(spark, "inv.two")
    sinks.drop_table(spark, "inv.two")
    assert not spark.catalog.tableExists("inv.two")
    lazy = readers.ingest(spark, {"x": readers.Parquet(str(tmp_path / "p"))}, save=False)
    assert lazy["x"].count() == 5 and not spark.catalog.tableExists("x")


def test_save_table_replaces(spark):
    sinks.save_table(spark.range(3), "replaced")
    assert sinks.save_table(spark.range(1).withColumn("d", F.lit("x")), "replaced", partition_by="d").count() == 1


def test_rewrite_table_reads_itself(spark):
    sinks.save_table(spark.range(10), "self")
    got = sinks.rewrite_table(spark.table("self").where("id < 3").withColumn("n", F.lit(1)), "self")
    assert got.count() == 3 and got.columns == ["id", "n"]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("self")] == ["self"]


def test_versions_behind_a_view(spark, monkeypatch):
    """The view shows whole versions only, also where a run stops between the steps."""
    first = sinks.publish_version(spark.range(10), "shown")
    assert first.count() == 10
    sinks.publish_version(spark.table("shown").where("id < 3").withColumn("n", F.lit(1)), "shown")
    assert spark.table("shown").columns == ["id", "n"] and spark.table("shown").count() == 3
    run = type(spark).sql

    def stops(self, query, *args, **more):
        if query.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("stopped")
        return run(self, query, *args, **more)

    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "sql", stops)
        with pytest.raises(RuntimeError):
            sinks.publish_version(spark.range(99), "shown")
    assert spark.table("shown").count() == 3
    for n in (5, 6, 7):
        sinks.publish_version(spark.range(n), "shown")
    assert spark.table("shown").count() == 7 and sinks.versions(spark, "shown") == ["shown__v4", "shown__v5"]
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    assert sinks.publish_version(spark.range(4), "kept.shown", None).count() == 4 and sinks.versions(spark, "kept.shown") == ["kept.shown__v1"]


@pytest.mark.parametrize("single", [True, False])
def test_csv_report(spark, tmp_path, single):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([(2, None), (1, "a,b")], "n int, t string").orderBy("n")
    sinks.write_report(df, path, single_file=single)
    back = spark.read.option("header", True).csv(path)
    assert [tuple(r) for r in back.orderBy("n").collect()] == [("1", "a,b"), ("2", None)]
    if single:
        assert len(glob.glob(path + "/part-*.csv")) == 1


def test_single_file_is_one_file_at_any_size(spark, tmp_path):
    sinks.write_report(spark.range(10_000).repartition(3), str(tmp_path / "r"), "parquet", single_file=True)
    assert len(glob.glob(str(tmp_path / "r") + "/part-*")) == 1


def csv_of(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_cells_with_quotes_and_line_breaks(spark, tmp_path):
    path = csv_of(tmp_path, 'a,b\n1,"say ""hi"", ok"\n2,"two\nlines"\n')
    rows = readers.Csv(path, "a int, b string", multi_line=True).read(spark).collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", ok'), (2, "two\nlines")]


def test_csv_header_has_to_fit_the_schema(spark, tmp_path):
    with pytest.raises(Exception, match="CSV header|column name"):
        readers.Csv(csv_of(tmp_path, "b,a\nx,1\n"), "a string, b string").read(spark).collect()


def test_csv_latin_and_malformed_rows(spark, tmp_path):
    source = readers.Csv(csv_of(tmp_path, "a,b\n1,é\nx,ü\n3\n4,y,z\n", "latin-1"), "a int, b string", encoding="ISO-8859-1")
    assert source.read(spark).first()["b"] == "é" and source.malformed_rows(spark) == 3


def test_stage_uses_the_named_folder(spark):
    staged = session.stage(spark.range(4), "t")
    assert session.shared_dir(spark) in staged.inputFiles()[0].replace("file://", "file:").replace("file:", "") and staged.count() == 4
