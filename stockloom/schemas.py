"""Fixed table schemas."""

from pyspark.sql import types as T


def _fields(spec):
    return T.StructType([T.StructField(name, kind, name not in REQUIRED) for name, kind in spec])


REQUIRED = {"invoice_item_number"}

_MONEY = T.DecimalType(10, 2)
_VOLUME = T.DecimalType(12, 3)
_TEXT = T.StringType()
_INT = T.IntegerType()

AUDIT_COLUMNS = ["created_timestamp", "updated_timestamp", "created_by", "updated_by"]

# Column names, order and types of the sales fact table.
SALES_SCHEMA = _fields(
    [
        ("id", T.LongType()),
        ("invoice_item_number", _TEXT),
        ("date", T.DateType()),
        ("store_number", _INT),
        ("store_name", _TEXT),
        ("address", _TEXT),
        ("city", _TEXT),
        ("zip_code", _TEXT),
        ("store_location", _TEXT),
        ("county_number", _INT),
        ("county", _TEXT),
        ("category", _TEXT),
        ("category_name", _TEXT),
        ("vendor_number", _INT),
        ("vendor_name", _TEXT),
        ("item_number", _TEXT),
        ("item_description", _TEXT),
        ("pack", _TEXT),
        ("bottle_volume_ml", _INT),
        ("state_bottle_cost", _MONEY),
        ("state_bottle_retail", _MONEY),
        ("bottles_sold", _INT),
        ("sale_dollars", _MONEY),
        ("volume_sold_liters", _VOLUME),
        ("volume_sold_gallons", _VOLUME),
        ("created_timestamp", T.TimestampNTZType()),
        ("updated_timestamp", T.TimestampNTZType()),
        ("created_by", _TEXT),
        ("updated_by", _TEXT),
    ]
)

# What a sales file holds: the fact table without the id and audit columns the table adds.
SALES_CSV_SCHEMA = T.StructType([f for f in SALES_SCHEMA if f.name not in ("id", *AUDIT_COLUMNS)])

# One detection message; `table` routes it to a lake table.
DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", _TEXT),
        T.StructField("class", _TEXT),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", _TEXT),
        T.StructField("table", _TEXT),
    ]
)

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("start_year", _INT),
        T.StructField("end_year", _INT),
        T.StructField("params", T.MapType(_TEXT, T.DoubleType())),
        T.StructField("model_blob", T.BinaryType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
