"""Text functions, near points and similar words."""

from pyspark.sql import functions as F

from checks.base import TYPE_WEEKS, query, table, type_weeks
from checks.sales import points_sql
from stockloom.functions import text
from stockloom.functions.records import to_number_or_zero
from stockloom.operators import joins, series


@query(
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS double), 0) AS k,
  coalesce(try_cast(props AS double), 0) AS whole FROM events"""
)
def numbers_or_zero(spark, d):
    events = table(spark, d, "events")
    return events.select(
        "event_id",
        to_number_or_zero(F.get_json_object("props", "$.k")).alias("k"),
        to_number_or_zero(F.col("props")).alias("whole"),
    )


@query(
    f"""SELECT p_type, timestamp, label AS link_text, 'https://files.example.com/agent/' || timestamp || '_' || type || '.json' AS url,
  round(value, 2) AS rounded_value, '{{"date":"' || timestamp || '","type":"' || type || '","definition":"Placeholder definition for '
  || timestamp || ' (' || type || ')"}}' AS payload FROM ({points_sql(TYPE_WEEKS, "p_type", False, 3)})"""
)
def point_links(spark, d):
    points = series.annotated_points(type_weeks(spark, d), ["p_type"], "week_start", "qty", keep=3)
    linked = text.agent_url(points, "https://files.example.com/agent/")
    return linked.select("p_type", "timestamp", "link_text", "url", "rounded_value", "payload")


READING = """SELECT c_custkey, lat, lon, CASE c_custkey % 3 WHEN 0 THEN lat || ' ' || lon || ' est.'
    WHEN 1 THEN 'Latitude: ' || lat || chr(10) || 'Longitude:  ' || lon ELSE 'no fix ' || c_name END AS reading
  FROM (SELECT c_custkey, c_name, (40 + c_custkey % 997) || '.' || (c_custkey % 90 + 10) AS lat,
    '-' || (c_custkey % 180) || '.' || (c_custkey % 70 + 10) AS lon FROM customer)"""


def readings(spark, d):
    key = F.col("c_custkey")
    lat = F.concat((key % 997 + 40).cast("string"), F.lit("."), (key % 90 + 10).cast("string"))
    lon = F.concat(F.lit("-"), (key % 180).cast("string"), F.lit("."), (key % 70 + 10).cast("string"))
    reading = (
        F.when(key % 3 == 0, F.concat(lat, F.lit(" "), lon, F.lit(" est.")))
        .when(key % 3 == 1, F.concat(F.lit("Latitude: "), lat, F.lit("\nLongitude:  "), lon))
        .otherwise(F.concat(F.lit("no fix "), F.col("c_name")))
    )
    return table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"), reading.alias("reading"))


@query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lat::double END AS latitude, CASE WHEN c_custkey % 3 < 2 THEN lon::double END AS longitude
FROM ({READING})"""
)
def parsed_positions(spark, d):
    return text.parse_lat_lon(readings(spark, d), "reading").select("c_custkey", "latitude", "longitude")


@query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'default_schema'
  ELSE 'geo_' || replace(lat, '.', '_') || '_' || replace(replace(lon, '.', '_'), '-', 'neg') END AS namespace FROM ({READING})"""
)
def position_namespaces(spark, d):
    shown = F.col("c_custkey") % 3 < 2
    name = text.location_namespace(F.when(shown, F.col("lat")), F.when(shown, F.col("lon")))
    return readings(spark, d).select("c_custkey", name.alias("namespace"))


@query(
    """SELECT page_id, CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '://([^/?#]*)', 1) END AS bucket,
  CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '://[^/?#]*/*([^?#]*)', 1) END AS prefix, url LIKE 'https://%' AS accepted FROM pages"""
)
def object_urls(spark, d):
    split = text.split_object_url(table(spark, d, "pages"), "url", scheme="https")
    return split.select("page_id", "bucket", "prefix", "accepted")


@query(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'list ' || p_name ELSE '/aa show ' || p_name || ', ' || p_type || '  by ' || p_brand || ', size' END AS raw FROM part),
q AS (SELECT p_partkey, trim(CASE WHEN starts_with(raw, '/aa') THEN substr(raw, 4) ELSE raw END) AS query FROM c)
SELECT p_partkey, query, CASE WHEN query LIKE 'show %' THEN regexp_replace(trim(regexp_extract(query, '^show\\s+([\\w\\s,]+)\\s+by\\s+', 1)), '\\s*,\\s*', '|', 'g') END AS metric,
  CASE WHEN query LIKE 'show %' THEN trim(regexp_extract(query, '\\s+by\\s+([\\w\\s,]+)', 1)) END AS dimension FROM q"""
)
def parsed_commands(spark, d):
    part = table(spark, d, "part")
    command = F.concat(F.lit("/aa show "), "p_name", F.lit(", "), "p_type", F.lit("  by "), "p_brand", F.lit(", size"))
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("list "), "p_name")).otherwise(command)
    parsed = text.parse_commands(part.select("p_partkey", raw.alias("raw")), "raw")
    return parsed.select("p_partkey", "query", F.array_join("metric", "|").alias("metric"), F.array_join("dimension", "|").alias("dimension"))


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^()]*[()]')) AS part,
    generate_subscripts(regexp_extract_all(text, '[^()]*[()]'), 1) AS i FROM documents),
e AS (SELECT doc_id, i, part, sum(length(part)) OVER w AS stop FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT *, last_value(CASE WHEN part LIKE '%(' THEN stop - 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM e)
SELECT doc_id, left(part, length(part) - 1) AS clause, coalesce(opened, 0)::int AS "start", stop::int AS "end" FROM o WHERE part LIKE '%)'"""
)
def bracket_clauses(spark, d):
    documents = table(spark, d, "documents").select("doc_id", text.paren_clauses(F.col("text")).alias("found"))
    return documents.select("doc_id", F.inline("found"))


def spots(df, key, shift):
    """Positions on a small grid: every key beyond a thousand falls on a spot that is taken already."""
    k = F.col(key)
    lat = 40 + (k * 3 % 1000) * 0.00005
    lon = -70 - ((k * 21 + shift) % 1000) * 0.00005
    return df.withColumns({"latitude": lat, "longitude": lon})


SPOTS = "40 + ({k} * 3 % 1000) * 0.00005::double AS latitude, -70 - (({k} * 21 + {shift}) % 1000) * 0.00005::double AS longitude"
POINTS = f"SELECT c_custkey AS id, c_name AS name, {SPOTS.format(k='c_custkey', shift='c_custkey % 4')} FROM customer"
KNOWN = f"SELECT s_suppkey AS id, s_name AS name, {SPOTS.format(k='s_suppkey', shift='0')} FROM supplier"
NEAR = f"""SELECT p.*, k.id AS match_id, k.name AS match_name FROM ({POINTS}) p LEFT JOIN ({KNOWN}) k
  ON abs(k.latitude - p.latitude) < 0.0001 AND abs(k.longitude - p.longitude) < 0.0001
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY k.id NULLS LAST) = 1"""


def _points(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return spots(customer, "id", F.col("id") % 4)


def _known(spark, d):
    return spots(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id", 0)


@query(NEAR)
def near_points(spark, d):
    return joins.near_locations(_points(spark, d), _known(spark, d))


# The plain rule: points in order of id, each added if nothing known or added before is near.
@query(
    f"""WITH RECURSIVE n AS (SELECT id, name, latitude, longitude, row_number() OVER (ORDER BY id) AS rn FROM ({NEAR}) WHERE match_id IS NULL),
s AS (SELECT 0::bigint AS step, []::STRUCT(id BIGINT, name VARCHAR, latitude DOUBLE, longitude DOUBLE)[] AS added
  UNION ALL SELECT step + 1, CASE WHEN len(list_filter(added, lambda a: abs(a.latitude - n.latitude) < 0.0001 AND abs(a.longitude - n.longitude) < 0.0001)) = 0
    THEN list_append(added, {{'id': n.id, 'name': n.name, 'latitude': n.latitude, 'longitude': n.longitude}}) ELSE added END FROM s JOIN n ON n.rn = step + 1)
SELECT * FROM ({KNOWN}) UNION ALL SELECT unnest(added, recursive := true) FROM (SELECT added FROM s ORDER BY step DESC LIMIT 1)"""
)
def points_added(spark, d):
    return joins.add_new_locations(_known(spark, d), _points(spark, d))


# Words of the sample dictionary: column names of a sales table.
DICTIONARY = ["total_sales", "revenue", "product", "region", "customer_id", "order_date", "quantity", "price"]


def words(spark, d):
    found = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    return table(spark, d, "documents").select(F.explode(found).alias("token")).filter(F.col("token") != "")


# DuckDB's edit distance counts bytes, so in the SQL a letter beyond a-z, which no word has, becomes one other sign.
@query(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents),
s AS (SELECT token, word, 1 - levenshtein(regexp_replace(token, '[^a-z]', '#', 'g'), word) / greatest(length(token), length(word)) AS score
  FROM w, unnest({DICTIONARY!r}) AS t(word))
SELECT token, word AS match FROM s WHERE score >= 0.4
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, word DESC) = 1
UNION ALL SELECT token, NULL FROM s GROUP BY token HAVING max(score) < 0.4"""
)
def words_by_edit_distance(spark, d):
    return joins.fuzzy_match(words(spark, d), spark.createDataFrame([(w,) for w in DICTIONARY], "word string"), 0.4)


# The SQL's candidates have their lengths near each other; as above a letter beyond a-z, which no name has, becomes one other sign.
@query(
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents),
v AS (SELECT token, regexp_replace(token, '[^a-z]', '#', 'g') AS plain FROM w),
p AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
s AS (SELECT token, word, 1 - levenshtein(plain, word) / greatest(length(token), length(word)) AS score FROM v JOIN p
  ON abs(length(token) - length(word)) <= 0.25 * greatest(length(token), length(word)) + 1),
b AS (SELECT token, word FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, word DESC) = 1)
SELECT token, word AS match FROM w LEFT JOIN b USING (token)"""
)
def words_like_item_names(spark, d):
    """A dictionary that is a table: the words of the items' names."""
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return joins.fuzzy_match(words(spark, d), names, 0.75)


@query()
def words_by_matching_blocks(spark, d):
    """Words of the items' names by the letters in matching blocks, which SQL does not count."""
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return joins.fuzzy_match(words(spark, d), names, 0.8, measure="blocks")
