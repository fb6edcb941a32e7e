import pytest
from pyspark.sql import functions as F

from stockloom.functions import records, text


def one(df):
    return df.first()


def test_commands(frame):
    df = frame(
        [("/aa show total_sales by brand",), ("show a , b_c by d, e; rest",), (" /aa show a by b",), ("list a by b",), ("Show a by b",), (None,)],
        "raw string",
    )
    rows = [(r.query, r.metric, r.dimension) for r in text.parse_commands(df, "raw").collect()]
    assert rows[0] == ("show total_sales by brand", ["total_sales"], ["brand"])
    assert rows[1] == ("show a , b_c by d, e; rest", ["a", "b_c"], ["d", "e"])
    assert rows[2] == ("/aa show a by b", None, None)
    assert rows[3][1:] == rows[4][1:] == rows[5][1:] == (None, None)


@pytest.mark.parametrize(
    "given, expected",
    [
        ("(show revenue by product) and (show total sales by region)", [("show revenue by product", 0, 25), ("show total sales by region", 30, 58)]),
        ("(a (b) c)", [("b", 3, 6), (" c", 3, 9)]),
        ("x) y", [("x", 0, 2)]),
        ("()", [("", 0, 2)]),
        ("(open", []),
        ("none", []),
        ("", []),
        ("é(ü)", [("ü", 1, 4)]),
    ],
)
def test_bracket_clauses(frame, given, expected):
    df = frame([(given,)], "t string").select(text.paren_clauses(F.col("t")).alias("c"))
    assert [tuple(c) for c in one(df).c] == expected


def test_positions(frame):
    df = frame(
        [("41.929065 -71.451711",), ("Latitude: 41.9\nLongitude: -71.4",), ("at +.5  7 now",), ("none",), ("Latitude: 3",), (None,)], "t string"
    )
    assert [(r.latitude, r.longitude) for r in text.parse_lat_lon(df, "t").collect()] == [
        (41.929065, -71.451711), (41.9, -71.4), (0.5, 7.0), (None, None), (None, None), (None, None),
    ]


def test_namespace(frame):
    df = frame([("41.9", "-71.4"), (None, "1"), ("", "1")], "lat string, lon string")
    names = [r[0] for r in df.select(text.location_namespace(F.col("lat"), F.col("lon"))).collect()]
    assert names == ["geo_41_9_neg71_4", "default_schema", "default_schema"]


def test_object_urls(frame):
    df = frame([("s3://my_bucket/a/b.json",), ("S3://b//x/",), ("http://b/x",), ("s3://b",), ("s3://b/k?v=1#f",), ("nothing",), (None,)], "u string")
    rows = [(r.bucket, r.prefix, r.accepted) for r in text.split_object_url(df, "u").collect()]
    assert rows == [
        ("my_bucket", "a/b.json", True), ("b", "x/", True), (None, None, False), ("b", "", True), ("b", "k", True),
        (None, None, False), (None, None, False),
    ]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('{"1": "rum", // sure\n "2": null}', {"1": "rum", "2": None}),
        ('{"1": 5}', {"1": "5"}),
        ("{'1': 'rum'}", {}),
        ('{"1": "rum"', {}),
        ('here: {"1": "rum"}', {}),
        ('["a"]', {}),
        ("", {}),
        (None, {}),
    ],
)
def test_label_answers(frame, answer, expected):
    df = frame([(answer,)], "t string").select(text.parse_label_response(F.col("t")).alias("m"))
    assert one(df).m == expected


def test_prompt_lines(frame):
    df = frame([(0, 2, "b", None), (0, 1, "a", "x"), (1, 3, "c", "y")], "batch int, item int, item_name string, category_name string")
    rows = {r.batch: r.lines for r in text.prompt_lines(df, "batch", "item", ["category_name", "item_name"]).collect()}
    assert rows[0] == "- item_number: 1, Category Name: x, Item Name: a\n- item_number: 2, Category Name: None, Item Name: b"


def test_point_links(frame):
    df = frame([("2025-07-07", 3.14159, None, "min")], "d string, value double, label string, type string")
    row = one(text.agent_url(df.selectExpr("to_date(d) AS timestamp", "value", "label", "type"), "https://x.example/agent/"))
    assert row.url == "https://x.example/agent/2025-07-07_min.json"
    assert (row.link_text, row.rounded_value) == ("2025-07-07 (min)", 3.14)


def test_records(frame):
    df = frame([("5", "a", ""), ("x", None, "b"), ("NaN", "", None)], "n string, f string, g string")
    assert [r[0] for r in df.select(records.to_number_or_zero(F.col("n"))).collect()] == [5.0, 0.0, 0.0]
    assert [r.missing_fields for r in records.missing_fields(df, ["f", "g"]).collect()] == [["g"], ["f"], ["f", "g"]]
    filled = records.with_detection_defaults(frame([("can", None)], "class string, source string")).first()
    assert (filled.source, filled.table) == ("unknown", "default") and filled.timestamp
    assert records.usable(frame([(1,), (0,), (None,), (-1,)], "v int"), "v").count() == 1
