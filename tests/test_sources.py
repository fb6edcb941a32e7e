import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom.plans import forecast
from stockloom.schemas import SALES_CSV_SCHEMA, SALES_SCHEMA
from stockloom.session import fresh_folder, shared_folder
from stockloom.sources import files, jdbc, tables


@pytest.fixture()
def database(spark):
    folder = fresh_folder(spark, "db")
    name = "db_" + folder.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return name


def test_csv_dates_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,item,n\n05/31/2019,a,1\n31/31/2019,b,2\n,c,\n")
    df = files.read_sales_csv(spark, str(tmp_path / "a.csv"), date_format="MM/dd/yyyy")
    assert [tuple(r) for r in df.collect()] == [(date(2019, 5, 31), "a", 1), (None, "b", 2), (None, "c", None)]
    typed = files.read_sales_csv(spark, str(tmp_path / "a.csv"), df.schema, date_format="MM/dd/yyyy")
    assert typed.schema == df.schema and typed.collect() == df.collect()


@pytest.mark.parametrize("text, form", [("2019-05-31", "yyyy-MM-dd"), ("20190531", "yyyyMMdd"), ("5/31/2019", "M/d/yyyy")])
def test_csv_date_formats(spark, tmp_path, text, form):
    (tmp_path / "a.csv").write_text(f"n,date\n1,{text}\n")
    assert files.read_sales_csv(spark, str(tmp_path / "a.csv"), date_format=form).first().date == date(2019, 5, 31)


def test_sales_file_with_schema(spark, tmp_path):
    assert len(SALES_CSV_SCHEMA) == 24
    values = {"date": "12/31/2020", "sale_dollars": "10.50", "bottles_sold": "3", "volume_sold_liters": "1.125"}
    names = SALES_CSV_SCHEMA.names
    (tmp_path / "s.csv").write_text(",".join(names) + "\n" + ",".join(values.get(n, "7") for n in names) + "\n")
    row = files.read_sales_csv(spark, str(tmp_path / "s.csv"), SALES_CSV_SCHEMA, date_format="MM/dd/yyyy").first()
    assert (row.date, str(row.sale_dollars), row.bottles_sold, str(row.volume_sold_liters)) == (date(2020, 12, 31), "10.50", 3, "1.125")
    (tmp_path / "other.csv").write_text(",".join(reversed(names)) + "\n" + ",".join("7" for _ in names) + "\n")
    with pytest.raises(Exception):
        files.read_sales_csv(spark, str(tmp_path / "other.csv"), SALES_CSV_SCHEMA).collect()


def test_partitioned_lake_table(spark, database):
    name = f"{database}.by_day"
    df = spark.sql("SELECT id, date_add(date'2024-01-01', cast(id % 3 AS int)) AS day FROM range(9)")
    tables.write_lake(df, name, partition_by=["day"])
    one = spark.table(name).filter("day = date'2024-01-02'")
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 3


def test_sales_schema():
    assert len(SALES_SCHEMA) == 29
    assert SALES_SCHEMA["sale_dollars"].dataType.simpleString() == "decimal(10,2)"
    assert SALES_SCHEMA["created_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert [f.name for f in SALES_SCHEMA if not f.nullable] == ["invoice_item_number"]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from stockloom.session import shared_folder

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda f: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=context)

    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[3,2,1024]"))
    assert shared_folder(session("spark://host:7077", "hdfs:/shared")) == "hdfs:/shared"
    assert shared_folder(session("local[4]"))


def test_routes_stay_text(spark, frame, tmp_path):
    prefix = str(tmp_path / "routes")
    rows = [("007", 1), ("7", 2), ("", 3), (None, 4), ("a b/c=d", 5), ("2024-01-01", 6)]
    tables.append_routed(frame(rows, "table string, n int"), prefix, batch_id=3)
    got = {r["table"]: r.n for r in tables.read_routed(spark, prefix).filter("n NOT IN (3)").collect()}
    assert got == {"007": 1, "7": 2, "default": 4, "a b/c=d": 5, "2024-01-01": 6}
    assert [r.n for r in tables.read_routed(spark, prefix, "7").collect()] == [2]
    assert sorted(r.n for r in tables.read_routed(spark, prefix, "default").collect()) == [3, 4]
    tables.append_routed(frame([("7", 9)], "table string, n int"), prefix, batch_id=4)
    tables.compact_routed(spark, prefix, f"{prefix}-closed", 4)
    assert sorted(r.n for r in tables.read_routed(spark, f"{prefix}-closed").collect()) == [1, 2, 3, 4, 5, 6]


def test_load_mapped(spark, database, tmp_path):
    (tmp_path / "a.csv").write_text("date,n\n2024-01-01,1\n")
    (tmp_path / "b.csv").write_text("date,n\n2024-01-02,2\n")
    mapping = {"a.csv": f"{database}.t", "none.csv": f"{database}.u", "b.csv": f"{database}.t"}
    assert tables.load_mapped(spark, mapping, str(tmp_path)) == [f"{database}.t"]
    assert spark.table(f"{database}.t").count() == 2
    tables.load_mapped(spark, mapping, str(tmp_path))
    loaded = spark.table(f"{database}.t")
    assert loaded.count() == 4 and loaded.select("id").distinct().count() == 4
    assert loaded.filter("created_by is null or date is null").count() == 0
    tables.load_mapped(spark, mapping, str(tmp_path), truncate=True)
    assert spark.table(f"{database}.t").count() == 2
    with pytest.raises(ValueError):
        tables.load_mapped(spark, {"none.csv": "t"}, str(tmp_path))


def test_list_preview_export(spark, database):
    spark.range(150).write.saveAsTable(f"{database}.numbers")
    spark.sql(f"CREATE VIEW {database}.seen AS SELECT * FROM {database}.numbers")
    spark.range(3).createOrReplaceTempView("temporary_numbers")
    assert [r.table_name for r in tables.list_tables(spark, database).collect()] == ["numbers"]
    assert tables.preview(spark, "numbers", database).count() == 100
    assert [r.id for r in tables.preview(spark, "numbers", database, 2, "id").collect()] == [0, 1]
    prefix = fresh_folder(spark, "export")
    folders = tables.export_schema_json(spark, database, prefix + "/")
    assert folders == {"numbers": f"{prefix}/{database}/numbers"}
    assert spark.read.json(folders["numbers"]).count() == 150


def test_table_from_json(spark, database, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"fruit": [{"label": "apple", "n": 1, "ok": True}, {"label": "fig", "n": 2.5, "more": {"x": 1}}]}))
    made = tables.table_from_json(spark, str(path), "fruit", f"{database}.fruit")
    made = tables.table_from_json(spark, str(path), "fruit", f"{database}.fruit")
    assert [(r.label, r.n, r.ok) for r in made.orderBy("label").collect()] == [("apple", 1.0, True), ("fig", 2.5, None)]
    assert set(made.columns) >= {"id", "created_timestamp", "updated_timestamp", "created_by", "updated_by", "more"}
    with pytest.raises(ValueError):
        tables.table_from_json(spark, str(path), "pears", f"{database}.pears")


def test_audit_ids_are_unique(spark):
    df = tables.with_audit_columns(spark.range(1000).repartition(8).toDF("n"))
    assert df.columns[0] == "id" and df.select("id").distinct().count() == 1000


def test_lake_replace_and_append(spark, database):
    name = f"{database}.fruit"
    tables.write_lake(spark.createDataFrame([(1, "apple")], "id long, label string"), name)
    tables.write_lake(spark.createDataFrame([(2, "fig")], "id long, label string"), name, "append")
    assert spark.table(name).count() == 2
    tables.write_lake(spark.createDataFrame([(3, "cherry")], "id long, label string"), name)
    assert [r.label for r in spark.table(name).collect()] == ["cherry"]


def test_routes_and_merged_schemas(spark, frame):
    prefix = fresh_folder(spark, "routes")
    tables.append_routed(frame([("x", 1), (None, 2)], "table string, n int"), prefix, batch_id=0)
    tables.append_routed(frame([("x", 3, "new")], "table string, n int, extra string"), prefix, batch_id=1)
    tables.append_routed(frame([("x", 3, "new")], "table string, n int, extra string"), prefix, batch_id=1)
    x = tables.read_routed(spark, prefix, "x")
    assert sorted((r.n, r.extra) for r in x.collect()) == [(1, None), (3, "new")] and "table" not in x.columns
    assert [r.n for r in tables.read_routed(spark, prefix, "default").collect()] == [2]
    whole = fresh_folder(spark, "routes")
    tables.append_routed(frame([(1,)], "n int"), whole)
    assert os.listdir(f"{whole}/table=default")


def test_schema_log(spark, frame, monkeypatch):
    """Columns come from the log, which grows by changes of schema; old tables get one, and a change of type is refused."""
    prefix = fresh_folder(spark, "routes")
    for batch, (row, kinds) in enumerate([(("x", 1), "n int"), (("x", 2), "n int"), (("y", 3, [1]), "n int, more array<int>"), (("x", 4), "n int")]):
        tables.append_routed(frame([row], f"table string, {kinds}"), prefix, batch_id=batch)
    assert spark.read.text(f"{prefix}.schemas").count() == 2
    with pytest.raises(ValueError):
        tables.append_routed(frame([("x", "5")], "table string, n string"), prefix, batch_id=9)
    monkeypatch.setattr(tables, "_footer_schema", None)
    stored = tables.read_routed(spark, prefix)
    assert sorted((r["table"], r.n, r.more, r.batch_id) for r in stored.collect()) == [("x", 1, None, 0), ("x", 2, None, 1), ("x", 4, None, 3), ("y", 3, [1], 2)]
    monkeypatch.undo()
    old = fresh_folder(spark, "routes")
    frame([("x", 1, True)], "table string, n int, flag boolean").write.partitionBy("table").parquet(old)
    assert tables.read_routed(spark, old, "x").first().flag
    tables.append_routed(frame([("z", 2)], "table string, n int"), old)
    assert sorted((r.n, r.flag, r["table"]) for r in tables.read_routed(spark, old).collect()) == [(1, True, "x"), (2, None, "z")]


def test_models(spark, frame):
    path = fresh_folder(spark, "models")
    schema = "start_year int, end_year int, params map<string,double>, model_blob binary"
    tables.save_models(frame([(2019, 2020, {"ar1": 0.5}, b"first"), (2020, 2021, {}, b"other")], schema), path)
    tables.save_models(frame([(2019, 2022, {"ar1": 0.7}, b"second")], schema), path)
    assert tables.load_models(spark, path).count() == 2
    row = tables.load_models(spark, path, 2019).first()
    assert (row.end_year, row.params, bytes(row.model_blob)) == (2022, {"ar1": 0.7}, b"second") and row.created_at


def test_fitted_model_survives_the_registry(spark, frame):
    path = fresh_folder(spark, "models")
    weeks = spark.sql("SELECT explode(sequence(date'2020-01-06', date'2021-12-27', interval 7 days)) AS week_start")
    weeks = weeks.withColumn("sales", F.when(F.weekofyear("week_start") % 4 == 0, 30.0).otherwise(10.0) + F.year("week_start"))
    tables.save_models(forecast.fit_models(weeks, [], lag=4, seasonal=(0, 1, 0), order=(0, 0, 0)), path)
    row = tables.load_models(spark, path, 2020).first()
    last = [r.sales for r in weeks.orderBy(F.desc("week_start")).limit(4).collect()][::-1]
    assert list(forecast.forecast_model(bytes(row.model_blob), 8)) == pytest.approx(last * 2)


def test_script(spark):
    results = tables.run_script(spark, "CREATE OR REPLACE TEMP VIEW s AS SELECT 1 AS a; ;SELECT a FROM s;\nSELECT a + 1 AS b FROM s;")
    assert [(s, df.first()[0]) for s, df in results] == [("SELECT a FROM s", 1), ("SELECT a + 1 AS b FROM s", 2)]


def test_csv_and_json_sinks(spark, frame, tmp_path):
    df = frame([("a", 1, None), ("b", 2, "x")], "k string, n int, t string")
    files.write_csv(df, str(tmp_path / "csv"), by="k")
    assert sorted(p for p in os.listdir(tmp_path / "csv") if p.startswith("k=")) == ["k=a", "k=b"]
    files.write_csv(df, str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 2
    files.write_json(df, str(tmp_path / "json"), by="k")
    assert sorted((r.k, r.n, r.t) for r in spark.read.json(str(tmp_path / "json")).collect()) == [("a", 1, None), ("b", 2, "x")]


class Recorder:
    """Stands for a reader or writer and keeps what is asked of it; no database takes part."""

    def __init__(self):
        self.seen, self.write, self.read = {}, self, self

    def repartition(self, n):
        self.seen["partitions"] = n
        return self

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def option(self, name, value):
        self.seen[name] = value
        return self

    def mode(self, name):
        self.seen["mode"] = name
        return self

    def save(self):
        return None

    def load(self):
        return self


def test_jdbc_options():
    out = Recorder()
    jdbc.write_jdbc(out, "jdbc:x", "sales", user="u")
    assert out.seen == {"partitions": 10, "format": "jdbc", "user": "u", "url": "jdbc:x", "dbtable": "sales", "batchsize": 50_000, "mode": "append"}
    plain = Recorder()
    jdbc.read_jdbc_query(plain, "jdbc:x", jdbc.weekly_aggregate_query("sales"), driver="d")
    assert plain.seen["query"].startswith("SELECT CAST(date_trunc('week', date) AS date) AS week_start") and plain.seen["driver"] == "d"
    wide = Recorder()
    jdbc.read_jdbc_query(wide, "jdbc:x", "SELECT 1 AS n", "n", (0, 9), 4)
    assert (wide.seen["dbtable"], wide.seen["numPartitions"], wide.seen["upperBound"]) == ("(SELECT 1 AS n) AS source_rows", 4, 9)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = fresh_folder(spark, "x")
    assert folder.startswith((named or shared_folder(spark)) + "/x-")
    assert folder != fresh_folder(spark, "x")


def test_models_of_other_keys_stay(spark, frame):
    path = fresh_folder(spark, "models")
    schema = "vendor string, start_year int, end_year int, params map<string,double>, model_blob binary"
    tables.save_models(frame([("A", 2019, 2020, {"ar1": 0.5}, b"a")], schema), path)
    tables.save_models(frame([("B", 2019, 2020, {"ar1": 0.7}, b"b"), (None, 2019, 2020, None, b"n")], schema), path)
    tables.save_models(frame([("A", 2019, 2021, {"ar1": 0.6}, b"a2")], schema), path)
    rows = {r.vendor: (r.end_year, bytes(r.model_blob)) for r in tables.load_models(spark, path, 2019).collect()}
    assert rows == {"A": (2021, b"a2"), "B": (2020, b"b"), None: (2020, b"n")}
    assert tables.load_models(spark, path, versions=True).count() == 4


@pytest.mark.parametrize(
    "script, parts",
    [
        ("SELECT 'a;b' AS x; SELECT 2", ["SELECT 'a;b' AS x", "SELECT 2"]),
        ("SELECT 'it''s; \\'; ok';;", ["SELECT 'it''s; \\'; ok'"]),
        ("-- only; a comment\n", []),
        ("SELECT `a;b`, \"c;d\" -- e;f\n FROM t; /* g; /* h; */ */ SELECT 1", ['SELECT `a;b`, "c;d" -- e;f\n FROM t', "/* g; /* h; */ */ SELECT 1"]),
        (
            "BEGIN IF 1 = 1 THEN SELECT 1; END IF; SELECT CASE WHEN 1 = 1 THEN 2 END; END; SELECT 3",
            ["BEGIN IF 1 = 1 THEN SELECT 1; END IF; SELECT CASE WHEN 1 = 1 THEN 2 END; END", "SELECT 3"],
        ),
        ("SELECT CASE a WHEN 1 THEN 2 END FROM t; SELECT 2;", ["SELECT CASE a WHEN 1 THEN 2 END FROM t", "SELECT 2"]),
        ("BEGIN BEGIN SELECT 1; END; WHILE x DO SET x = 1; END WHILE; END", ["BEGIN BEGIN SELECT 1; END; WHILE x DO SET x = 1; END WHILE; END"]),
    ],
)
def test_statements_of_a_script(script, parts):
    assert tables.split_script(script) == parts


def test_a_block_runs_as_one(spark):
    results = tables.run_script(spark, "SELECT 'a;b' AS x; BEGIN DECLARE n INT DEFAULT 1; SET n = n + 1; SELECT n AS y, ';' AS z; END; SELECT 3 AS w")
    assert [df.collect()[0].asDict() for _, df in results] == [{"x": "a;b"}, {"y": 2, "z": ";"}, {"w": 3}]
