"""Readers and writers: each query writes to the shared folder and reads back."""

from pyspark.sql import functions as F

from checks.base import DETECTIONS, PART_WEEKS, detections, part_weeks, query, sales, table
from checks.people import label_answers
from stockloom.functions.records import with_detection_defaults
from stockloom.functions.text import parse_label_response
from stockloom.operators import joins
from stockloom.operators.aggregate import detection_summary, iso_weekly_sales
from stockloom.session import fresh_folder
from stockloom.sources import files, tables
from stockloom.streaming.detections import detections_from_json, detections_to_json

def us_date():
    return F.date_format("sales_date", "MM/dd/yyyy").alias("date")


@query(
    """SELECT extract(isoyear FROM l_shipdate)::int AS sales_year, extract(week FROM l_shipdate)::int AS sales_week,
  sum(l_quantity)::bigint AS sales_quantity FROM lineitem GROUP BY ALL"""
)
def csv_scan(spark, d):
    path = fresh_folder(spark, "csv")
    files.write_csv(sales(spark, d).select(us_date(), "bottles", "l_partkey"), path)
    read = files.read_sales_csv(spark, path, schema="date date, bottles int, l_partkey long", date_format="MM/dd/yyyy")
    return iso_weekly_sales(read, "date", "bottles")


@query("SELECT l_linestatus, count(*) AS n, sum(l_quantity)::bigint AS bottles, max(l_shipdate)::date AS latest FROM lineitem GROUP BY 1")
def csv_files_loaded(spark, d):
    root = fresh_folder(spark, "load")
    rows = sales(spark, d).select(us_date(), "bottles", "l_linestatus")
    statuses = [r[0] for r in rows.select("l_linestatus").distinct().orderBy("l_linestatus").collect()]
    for status in statuses:
        files.write_csv(rows.filter(F.col("l_linestatus") == status), f"{root}/{status}.csv")
    target = f"loaded_{root.rsplit('-', 1)[1]}"
    mapping = {f"{name}.csv": target for name in [*statuses, "missing"]}
    schema = "date date, bottles int, l_linestatus string"
    tables.load_mapped(spark, mapping, root, truncate=True, schema=schema, date_format="MM/dd/yyyy", table_path=lambda t: f"{root}/table/{t}")
    return spark.table(target).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bottles").cast("long").alias("bottles"), F.max("date").alias("latest")
    )


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS stamped FROM lineitem")
def audit_columns(spark, d):
    stamped = tables.with_audit_columns(table(spark, d, "lineitem"))
    filled = F.count_if(F.col("created_by").isNotNull() & F.col("updated_timestamp").isNotNull())
    return stamped.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), filled.alias("stamped"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def table_preview(spark, d):
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").createOrReplaceTempView("preview_orders")
    return tables.preview(spark, "preview_orders", order_by="o_orderkey")


@query(
    """SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::bigint AS total FROM customer
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::bigint FROM orders"""
)
def schema_export(spark, d):
    root = fresh_folder(spark, "export")
    schema = "export_" + root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{root}/db'")
    for name in ("customer", "orders"):
        table(spark, d, name).write.option("path", f"{root}/tables/{name}").saveAsTable(f"{schema}.{name}")
    folders = tables.export_schema_json(spark, schema, f"{root}/json")
    keys = {"customer": "c_custkey", "orders": "o_orderkey"}
    parts = [
        spark.read.json(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(keys[name]).alias("total"))
        for name, path in sorted(folders.items())
    ]
    return parts[0].unionByName(parts[1])


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def table_from_json(spark, d):
    root = fresh_folder(spark, "json")
    table(spark, d, "customer").select(F.array(F.struct("*")).alias("customer")).write.json(f"{root}/in")
    name = "from_json_" + root.rsplit("-", 1)[1]
    made = tables.table_from_json(spark, f"{root}/in", "customer", name, f"{root}/table", multi_line=False)
    return made.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, 'a "quoted\\", [text] {of ' || o_orderpriority AS note,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderkey::varchar END AS mixed, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate::date::varchar END AS rare FROM orders"""
)
def table_from_large_json(spark, d):
    """Documents of many orders each, cut by several tasks: signs within texts, fields that differ in type or are there for few rows."""
    root = fresh_folder(spark, "json")
    key = F.col("o_orderkey")
    fields = [
        "o_orderkey", "o_custkey", "o_totalprice",
        F.concat(F.lit('a "quoted\\", [text] {of '), "o_orderpriority").alias("note"),
        F.when(key % 3 != 0, key).alias("mixed"),
        F.when(key % 7 == 0, F.col("o_orderdate").cast("date").cast("string")).alias("rare"),
    ]
    orders = table(spark, d, "orders").withColumn("document", F.floor(key / 20_000))
    whole = F.to_json(F.struct(*fields))
    # A third of the rows have text where the others have a number.
    text = F.when(key % 3 == 0, F.concat(F.expr("rtrim('}', value)"), F.lit(',"mixed":"'), F.col("o_orderstatus"), F.lit('"}'))).otherwise(F.col("value"))
    rows = orders.withColumn("value", whole).select("document", key.alias("place"), text.alias("value"))
    first = rows.groupBy("document").agg(F.min("place").alias("least"))
    rows = rows.join(first, "document").select("document", "place", F.concat(F.when(F.col("place") > F.col("least"), ",\n").otherwise(""), "value").alias("value"))
    top = first.select("document", F.lit(-1).alias("place"), F.lit('{"made": "orders: [", "parts": {"orders": [1]}, "orders": [').alias("value"))
    end = first.select("document", F.lit(None).cast("long").alias("place"), F.lit('], "n": [2, 3]}').alias("value"))
    # Dealt by a hash of the document: where the parts of the union are dealt by the document itself, as after a join by shuffle, Spark takes
    # the union to be so too and leaves a repartition by it out, though the parts of a document then lie in different partitions.
    pieces = rows.unionByName(top).unionByName(end).repartition(F.xxhash64("document")).sortWithinPartitions("document", F.asc_nulls_last("place"))
    pieces.select("document", "value").write.partitionBy("document").text(f"{root}/in")
    name = "from_large_json_" + root.rsplit("-", 1)[1]
    made = tables.table_from_json(spark, f"{root}/in", "orders", name, f"{root}/table", block=256 << 10)
    return made.select("o_orderkey", "o_custkey", "o_totalprice", "note", "mixed", "rare")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def lake_table(spark, d):
    root = fresh_folder(spark, "lake")
    name = "lake_" + root.rsplit("-", 1)[1]
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    tables.write_lake(supplier, name, path=root)
    tables.write_lake(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").toDF(*supplier.columns), name, "append")
    return spark.table(name)


@query(
    f"""SELECT coalesce("table", 'default') AS "table", class, count(*) AS n, sum(arrival)::bigint AS arrivals
FROM ({DETECTIONS}) GROUP BY ALL"""
)
def routed_append(spark, d):
    target = fresh_folder(spark, "routed")
    tables.append_routed(detections(spark, d), target)
    return tables.read_routed(spark, target).groupBy("table", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("arrival").alias("arrivals")
    )


# Names that look alike as numbers, and an empty one.
ROUTES = """CASE event_id % 5 WHEN 0 THEN '007' WHEN 1 THEN '7' WHEN 2 THEN '' WHEN 3 THEN 'a=b/c' END"""


@query(
    f"""SELECT coalesce(nullif({ROUTES}, ''), 'default') AS "table", count(*) AS n, sum(event_id)::bigint AS arrivals FROM events GROUP BY ALL"""
)
def routed_append_odd_names(spark, d):
    target = fresh_folder(spark, "routed")
    events = table(spark, d, "events").withColumn("table", F.expr(ROUTES)).select("table", "event_id")
    tables.append_routed(events, target, batch_id=0)
    tables.append_routed(events, target, batch_id=0)
    tables.compact_routed(spark, target, f"{target}-compact", 1)
    stored = tables.read_routed(spark, f"{target}-compact")
    return stored.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("arrivals"))


@query(
    f"""SELECT timestamp, class, confidence, coalesce(source, 'unknown') AS source, coalesce("table", 'default') AS "table", arrival
FROM ({DETECTIONS})"""
)
def detection_defaults(spark, d):
    return with_detection_defaults(detections(spark, d))


@query(f"SELECT timestamp, class, confidence, source FROM ({DETECTIONS}) WHERE confidence >= 0.25")
def detection_json(spark, d):
    return detections_from_json(detections_to_json(detections(spark, d))).select("timestamp", "class", "confidence", "source")


@query(
    f"""SELECT class, arg_max(timestamp, arrival) AS last_seen, count(*) AS count, arg_max(coalesce(source, 'unknown'), arrival) AS source
FROM ({DETECTIONS}) GROUP BY 1"""
)
def class_summary(spark, d):
    return detection_summary(with_detection_defaults(detections(spark, d)), "arrival")


@query(
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity)::bigint AS bottles, max(l_partkey) AS last_part FROM lineitem GROUP BY 1"""
)
def csv_sink_by_key(spark, d):
    path = fresh_folder(spark, "sink")
    files.write_csv(sales(spark, d).select("l_returnflag", "l_partkey", "bottles"), path, by="l_returnflag")
    read = spark.read.option("header", True).schema("l_partkey long, bottles int, l_returnflag string").csv(path)
    return read.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bottles").alias("bottles"), F.max("l_partkey").alias("last_part")
    )


@query(
    f"""SELECT year(week_start)::int AS start_year, year(week_start)::int AS end_year, round(avg(qty), 6) AS mean,
  '{{"n":' || count(*) || ',"total":' || sum(qty)::bigint || '}}' AS blob FROM ({PART_WEEKS}) GROUP BY 1"""
)
def model_registry(spark, d):
    path = fresh_folder(spark, "models")
    year = F.year("week_start")
    yearly = part_weeks(spark, d).groupBy(year.alias("start_year")).agg(
        F.avg("qty").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("qty").alias("total")
    )
    models = yearly.select(
        "start_year",
        F.col("start_year").alias("end_year"),
        F.create_map(F.lit("mean"), F.round("mean", 6)).alias("params"),
        F.to_json(F.struct("n", "total")).cast("binary").alias("model_blob"),
    )
    tables.save_models(models, path)
    # A second save of the same years replaces the first.
    tables.save_models(models, path)
    loaded = tables.load_models(spark, path)
    return loaded.select("start_year", "end_year", F.col("params.mean").alias("mean"), F.col("model_blob").cast("string").alias("blob"))


@query(
    f"""WITH y AS (SELECT p_type, year(week_start)::int AS start_year, sum(qty)::bigint AS total
  FROM ({PART_WEEKS}) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY start_year) AS models FROM y"""
)
def model_registry_by_key(spark, d):
    """Models of each item type are saved by themselves, some of them twice: none replaces those of another type."""
    path = fresh_folder(spark, "models")
    typed = part_weeks(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    models = typed.groupBy("p_type", F.year("week_start").alias("start_year")).agg(F.sum("qty").alias("total"))
    blob = F.col("total").cast("string").cast("binary").alias("model_blob")
    models = models.select("p_type", "start_year", F.col("start_year").alias("end_year"), F.create_map(F.lit("half"), F.col("total") / 2).alias("params"), blob)
    early = F.col("p_type") < "M"
    tables.save_models(models.where(early).withColumn("model_blob", F.lit("old").cast("binary")), path)
    tables.save_models(models.where(~early), path)
    tables.save_models(models.where(early), path)
    loaded = tables.load_models(spark, path)
    per_year = loaded.groupBy("start_year").agg(F.count(F.lit(1)).alias("models"))
    return loaded.join(per_year, "start_year").select("p_type", "start_year", F.col("model_blob").cast("string").cast("long").alias("total"), "models")


@query("SELECT 'a;b' AS mark, o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL")
def script_with_quotes(spark, d):
    """Semicolons within quotes, comments and blocks end no statement."""
    results = tables.run_script(
        spark,
        f"""-- orders; all of them
        CREATE OR REPLACE TEMPORARY VIEW `script;orders` AS SELECT * FROM parquet.`{d}/orders.parquet`; /* one; /* two; */ three; */
        SELECT CASE WHEN count(*) > 0 THEN 'some;' ELSE "none;" END AS c FROM `script;orders`;
        SELECT 'a;b' AS mark, o_orderstatus, count(*) AS n FROM `script;orders` WHERE o_totalprice > 1000 GROUP BY ALL -- done;""",
    )
    return results[-1][1]


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def script_last_result(spark, d):
    path = f"{d}/orders.parquet"
    results = tables.run_script(
        spark,
        f"""CREATE OR REPLACE TEMPORARY VIEW script_orders AS SELECT * FROM parquet.`{path}`;
        CREATE OR REPLACE TEMPORARY VIEW script_large AS SELECT * FROM script_orders WHERE o_totalprice > 1000;
        SELECT max(o_orderkey) AS top FROM script_large;
        SELECT o_orderstatus, count(*) AS n FROM script_large GROUP BY 1;""",
    )
    return results[-1][1]


@query(
    """SELECT p_partkey % 16 AS batch, count(*) AS n, count(segment) AS labelled FROM
  (SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS segment FROM part) GROUP BY 1"""
)
def label_batch_files(spark, d):
    path = fresh_folder(spark, "batches")
    answers = label_answers(spark, d).select(parse_label_response(F.col("answer")).alias("labels"))
    items = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 16).alias("batch"))
    files.write_json(joins.apply_labels(items, answers, "p_partkey", "segment"), path, by="batch")
    read = spark.read.schema("p_partkey long, segment string, batch long").json(path)
    return read.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("labelled"))
