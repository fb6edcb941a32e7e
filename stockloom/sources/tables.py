"""Catalog tables: load, list, preview, export, scripts, lake tables, models."""

import json
import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.sources.files import path_exists, read_json_rows, read_sales_csv, write_json
from stockloom.sources.json_lists import read_json_list


def with_audit_columns(df, id_col="id", start=0):
    """Add a unique id from `start` on (not dense) and creation and update time and user."""
    now, user = F.current_timestamp(), F.current_user()
    stamped = df.withColumns(
        {"created_timestamp": now, "updated_timestamp": now, "created_by": user, "updated_by": user}
    )
    row_id = (F.monotonically_increasing_id() + F.lit(start)).alias(id_col)
    return stamped.select(row_id, *[c for c in stamped.columns if c != id_col])


def load_mapped(
    spark, mapping, load_dir, truncate=False, schema=None, date_format="yyyy-MM-dd", table_path=None, audit=True
):
    """Load the files of `mapping` (file name to table) that exist; returns the tables touched.

    All files of a table are read and written together; give their schema, or they are read twice to find the types. With
    `truncate` they replace its rows, without they are added. Rows get the id and audit columns, ids going on from those in the
    table. `table_path(table)` may name the folder of a table.
    """
    files = {}
    for name, table in mapping.items():
        path = posixpath.join(load_dir, name)
        if path_exists(spark, path):
            files.setdefault(table, []).append(path)
    if not files:
        raise ValueError("no files to load: check the folder and the mapping")
    for table, paths in files.items():
        df = read_sales_csv(spark, paths, schema=schema, date_format=date_format)
        if audit:
            taken = not truncate and spark.catalog.tableExists(table)
            last = spark.table(table).agg(F.max("id")).first()[0] if taken else None
            df = with_audit_columns(df, start=0 if last is None else last + 1)
        writer = df.write.mode("overwrite" if truncate else "append")
        if table_path is not None:
            writer = writer.option("path", table_path(table))
        writer.saveAsTable(table)
    return list(files)


def list_tables(spark, schema):
    """Names of the base tables of a schema; views are left out."""
    tables = [t for t in spark.catalog.listTables(schema) if not t.isTemporary and t.tableType != "VIEW"]
    return spark.createDataFrame([(t.name,) for t in tables], "table_name string")


def preview(spark, table, schema=None, limit=100, order_by=None):
    """First rows of a table. Without `order_by` any rows may come."""
    df = spark.table(f"{schema}.{table}" if schema else table)
    if order_by:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.limit(limit)


def export_schema_json(spark, schema, prefix, limit=None):
    """Write every base table of a schema as JSON lines under prefix/schema/table; returns the folders."""
    folders = {}
    for row in list_tables(spark, schema).collect():
        name = row["table_name"]
        df = spark.table(f"{schema}.{name}")
        folders[name] = posixpath.join(prefix.rstrip("/"), schema, name)
        write_json(df if limit is None else df.limit(limit), folders[name])
    return folders


def table_from_json(spark, path, key, table, table_path=None, multi_line=True, block=None):
    """Replace a table by the rows under a key of a JSON file, with audit columns. With `block`, documents are read by many tasks in
    blocks of so many bytes; without, a document is the work of one task."""
    rows = read_json_rows(spark, path, key, multi_line) if block is None else read_json_list(spark, path, key, block)
    writer = with_audit_columns(rows).write.mode("overwrite")
    if table_path is not None:
        writer = writer.option("path", table_path)
    writer.saveAsTable(table)
    return spark.table(table)


#: Quoted texts and names, comments, words and single signs of a script. A backslash takes the next sign along within quotes.
_SCRIPT_PIECE = re.compile(
    r"""'(?:\\.|''|[^'\\])*' | "(?:\\.|""|[^"\\])*" | `(?:``|[^`])*` | --[^\n]* | /\* | \w+ | .""", re.DOTALL | re.VERBOSE
)
#: Statements whose end is END and their own word, which are not counted.
_OWN_END = {"IF", "WHILE", "LOOP", "REPEAT", "FOR"}


def split_script(text):
    """The statements of a script, without comments around them. A `;` within quotes, comments or BEGIN ... END ends none."""
    out, at, start, depth, ended, seen = [], 0, 0, 0, False, False
    while at < len(text):
        piece = _SCRIPT_PIECE.match(text, at)
        token, end = piece.group(), piece.end()
        if token == "/*":  # these may hold others
            level = 1
            while level and end < len(text):
                level += {"/*": 1, "*/": -1}.get(text[end : end + 2], 0)
                end += 2 if text[end : end + 2] in ("/*", "*/") else 1
        elif not token.startswith("--"):
            word = token.upper()
            if word == ";" and depth == 0:
                if seen:
                    out.append(text[start:at].strip())
                start, seen = end, False
            elif not token.isspace():
                seen = True
                if ended and word in _OWN_END:
                    depth += 1  # the END before closed none of those counted
                ended = word == "END" and depth > 0
                if word == "END":
                    depth = max(0, depth - 1)
                elif word == "BEGIN" or (word == "CASE" and not text[:at].rstrip().upper().endswith("END")):
                    depth += 1
        at = end
    if seen:
        out.append(text[start:].strip())
    return out


def run_script(spark, text):
    """Run the statements of a script; returns (statement, DataFrame) for those that yield rows. BEGIN ... END is run as one."""
    results = []
    for statement in split_script(text):
        df = spark.sql(statement)
        if df.columns:
            results.append((statement, df))
    return results


def write_lake(df, table, mode="replace", fmt="parquet", path=None, partition_by=()):
    """Create, replace or append a lake table, partitioned by columns if wanted.

    Catalogs of a lake format go through the V2 writer; the built-in catalog has Parquet tables, written by saveAsTable.
    """
    if fmt == "parquet":
        writer = df.write.format(fmt).mode("overwrite" if mode == "replace" else "append")
        if path is not None:
            writer = writer.option("path", path)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(table)
        return
    writer = df.writeTo(table).using(fmt)
    if mode == "replace":
        if partition_by:
            writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
        writer.createOrReplace()
    else:
        writer.option("merge-schema", "true").append()


def append_routed(df, prefix, route_col="table", default="default", batch_id=None):
    """Append each row to the Parquet table of its route, `prefix/<route_col>=<route>`, in one pass over the data.

    Rows without a route, or with an empty one, go to the default. The route column is not stored in the rows. Rows of a route are
    brought together before they are written, in parts of a useful size, so a batch adds few files. With a batch id the rows go to a
    folder of that batch, which a second write of the same batch replaces, so a replay adds nothing. New columns go to a log of schemas,
    `<prefix>.schemas`, before the rows; a column that changes its type is an error, and nothing is written.
    """
    given = F.col(route_col).cast("string") if route_col in df.columns else F.lit(None).cast("string")
    routed = df.withColumn(route_col, F.when(F.coalesce(given, F.lit("")) == "", F.lit(default)).otherwise(given)).hint("rebalance", route_col)
    if batch_id is not None:
        routed = routed.withColumn("batch_id", F.lit(batch_id).cast("long"))
    _log_schema(df.sparkSession, prefix, routed.schema)
    if batch_id is None:
        routed.write.mode("append").partitionBy(route_col).parquet(prefix)
        return
    writer = routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(route_col, "batch_id").parquet(prefix)


def _schema_log(prefix):
    return f"{prefix.rstrip('/')}.schemas"


def _logged_schemas(spark, prefix):
    """The schemas in the log, one per line, in an order that stays the same; none without a log."""
    path = _schema_log(prefix)
    if not path_exists(spark, path):
        return []
    lines = spark.read.schema("value string").text(path).distinct().collect()
    return [T.StructType.fromJson(json.loads(line)) for line in sorted(r["value"] for r in lines)]


def _merged(schemas):
    """All columns of the schemas. A column is stored in one type only."""
    fields = {}
    for schema in schemas:
        for f in schema.fields:
            known = fields.setdefault(f.name, f.dataType)
            if known != f.dataType:
                raise ValueError(f"column {f.name} is stored as {known.simpleString()} and as {f.dataType.simpleString()}")
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _log_schema(spark, prefix, schema):
    """Add a schema to the log beside the tables unless it has its columns. The log has a line per change of schema, not per batch, and
    is written before the rows, so it never lacks a column that is stored."""
    plain = T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in schema.fields])
    logged = _logged_schemas(spark, prefix)
    if not logged and path_exists(spark, prefix):  # tables older than their log
        try:
            logged = [_footer_schema(spark, prefix)]
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # raised where nothing but empty batches were written
                raise
        else:
            spark.createDataFrame([(logged[0].json(),)], "value string").coalesce(1).write.mode("append").text(_schema_log(prefix))
    known = _merged(logged)
    if _merged([known, plain]) != known:
        spark.createDataFrame([(plain.json(),)], "value string").coalesce(1).write.mode("append").text(_schema_log(prefix))


def _nullable(kind):
    """A type as files give it back: all within it may be NULL."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    return kind


def _footer_schema(spark, prefix):
    found = spark.read.option("mergeSchema", True).parquet(prefix).schema
    return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in found.fields])


def read_routed(spark, prefix, route=None, route_col="table"):
    """One routed table, or all of them with the route column, which is text; schemas of all batches are merged.

    Columns come from the schema log that is written beside the tables; only where there is none are the files' footers read.
    """
    logged = _logged_schemas(spark, prefix)
    found = _merged(logged) if logged else _footer_schema(spark, prefix)
    parts = [route_col, "batch_id"]
    fields = [f for f in found.fields if f.name not in parts]
    fields += [T.StructField(f.name, T.StringType() if f.name == route_col else f.dataType) for n in parts for f in found.fields if f.name == n]
    stored = spark.read.schema(T.StructType(fields)).parquet(prefix)
    return stored if route is None else stored.filter(F.col(route_col) == route).drop(route_col)


def compact_routed(spark, prefix, target, before, route_col="table"):
    """Write the rows of all batches before `before` to routed tables below `target`, without batch folders and in files of a useful
    size. The batches are closed and stay where they are; drop them when readers use the new folder."""
    closed = read_routed(spark, prefix, route_col=route_col).filter(F.col("batch_id") < before).drop("batch_id")
    _log_schema(spark, target, closed.schema)
    closed.hint("rebalance", route_col).write.mode("overwrite").partitionBy(route_col).parquet(target)


#: What a stored model holds beside what it is known by: its keys and start year.
MODEL_VALUES = ["end_year", "params", "model_blob", "status", "created_at"]


def save_models(models, path):
    """Store models (start_year, end_year, params, model_blob, perhaps status); all other columns are their keys.

    Each save adds a version, by its time; none is changed or removed, so models of other keys and years stay as they are.
    Fitted parameters stay readable beside the blob; the files are compressed.
    """
    stored = models.withColumn("created_at", F.current_timestamp())
    stored.write.mode("append").option("compression", "zstd").partitionBy("start_year").parquet(path)


def load_models(spark, path, start_year=None, versions=False):
    """The latest version of each model, or with `versions` all of them."""
    models = spark.read.option("mergeSchema", True).parquet(path)
    models = models if start_year is None else models.filter(F.col("start_year") == start_year)
    if versions:
        return models
    values = [c for c in models.columns if c in MODEL_VALUES]
    known_by = [c for c in models.columns if c not in values]
    latest = models.groupBy(*known_by).agg(F.max_by(F.struct(*values), "created_at").alias("_latest"))
    return latest.select(*[F.col(f"_latest.{c}").alias(c) if c in values else F.col(c) for c in models.columns])
