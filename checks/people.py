"""Dimensions, users and labels."""

from pyspark.sql import functions as F

from checks.base import query, table
from stockloom.functions.records import missing_fields
from stockloom.functions.text import parse_label_response, prompt_lines
from stockloom.operators import dimension, joins
from stockloom.operators.aggregate import collapse_items
from stockloom.operators.keys import spread
from stockloom.plans.labelling import label_items
from stockloom.session import fresh_folder


def items_sold(spark, d):
    """Items with description and category, one row per vendor that sold them."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    sold = spread(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct(), ["l_partkey"])
    return sold.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "l_suppkey")


SOLD = "SELECT p_partkey, p_name, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey"


def item_dim(spark, d):
    """Dimension that lacks some types of items and has no label for others."""
    part = table(spark, d, "part").filter(~F.col("p_type").isin("PROMO", "LARGE"))
    unlabelled = F.col("p_type").isin("SMALL", "MEDIUM")
    return part.select("p_partkey", "p_name", "p_type", F.when(~unlabelled, F.lower("p_type")).alias("segment"))


DIM = """SELECT p_partkey, p_name, p_type, CASE WHEN p_type NOT IN ('SMALL', 'MEDIUM') THEN lower(p_type) END AS segment
  FROM part WHERE p_type NOT IN ('PROMO', 'LARGE')"""


@query(
    f"""SELECT DISTINCT s.p_partkey, s.p_name, s.p_type FROM ({SOLD}) s LEFT JOIN ({DIM}) dim USING (p_partkey)
WHERE dim.p_partkey IS NULL OR dim.segment IS NULL"""
)
def items_without_label(spark, d):
    return joins.items_to_label(items_sold(spark, d), item_dim(spark, d), "p_partkey", "segment", ["p_name", "p_type"])


@query(
    f"""SELECT p_partkey, min(p_name) AS p_name, min(p_type) AS p_type, max(CASE WHEN p_partkey % 4 > 0 THEN upper(p_name) END) AS segment
FROM ({SOLD}) GROUP BY 1"""
)
def collapsed_items(spark, d):
    labelled = items_sold(spark, d).withColumn("segment", F.when(F.col("p_partkey") % 4 > 0, F.upper("p_name")))
    return collapse_items(labelled, "p_partkey", ["p_name", "p_type"], "segment")


@query(
    f"""WITH u AS (SELECT p_partkey, min(p_name) AS p_name, min(p_type) AS p_type, max(split_part(p_name, ' ', 1)) AS segment
  FROM ({SOLD}) WHERE l_returnflag = 'R' GROUP BY 1)
SELECT * FROM ({DIM}) WHERE p_partkey NOT IN (SELECT p_partkey FROM u) UNION ALL SELECT * FROM u"""
)
def dimension_upsert(spark, d):
    returned = items_sold(spark, d).filter(F.col("l_returnflag") == "R").drop("l_returnflag")
    updates = returned.withColumn("segment", F.split("p_name", " ")[0])
    return dimension.upsert_dimension(item_dim(spark, d), updates, "p_partkey", ["p_name", "p_type"], "segment")


USERS = """SELECT c_custkey AS user_id, c_name AS first_name, c_mktsegment AS last_name,
  'user' || c_custkey || '@example.com' AS email, 'n' || c_nationkey AS phone_number FROM customer"""


def users(spark, d):
    customer = table(spark, d, "customer")
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("phone_number"),
    )


def registrations(spark, d):
    """Orders as registrations: customers sign up again and again, some under an address not seen before."""
    orders = table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    prefix = F.when(F.col("o_orderkey") % 9 == 0, "guest").otherwise("user")
    return orders.select(
        F.concat(prefix, key, F.lit("@example.com")).alias("email"),
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("first_name"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("last_name"),
        F.col("o_orderstatus").alias("unknown_column"),
        F.col("o_orderkey").alias("seq"),
    )


REGISTERED = """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'guest' ELSE 'user' END || o_custkey || '@example.com' AS email,
  'F' || o_orderkey AS first_name, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS last_name,
  o_orderstatus AS unknown_column, o_orderkey AS seq FROM orders"""


@query(
    f"""WITH u AS (SELECT p_partkey, min(p_name) AS p_name, min(p_type) AS p_type, max(upper(p_name)) AS segment
  FROM (SELECT CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS p_partkey, p_name, p_type FROM part WHERE p_partkey % 3 = 0) GROUP BY 1),
dim AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN p_partkey END AS p_partkey, p_name, p_type, segment FROM ({DIM}))
SELECT coalesce(d.p_partkey, u.p_partkey) AS p_partkey, CASE WHEN u.p_partkey IS NOT NULL THEN u.p_name ELSE d.p_name END AS p_name,
  CASE WHEN u.p_partkey IS NOT NULL THEN u.p_type ELSE d.p_type END AS p_type,
  CASE WHEN u.p_partkey IS NOT NULL THEN u.segment ELSE d.segment END AS segment
FROM dim d FULL JOIN (SELECT * FROM u WHERE p_partkey IS NOT NULL) u ON d.p_partkey = u.p_partkey"""
)
def dimension_upsert_null_keys(spark, d):
    """Updates without a key are left out; dimension rows without one stay."""
    without = lambda frame, k: frame.withColumn("p_partkey", F.when(F.col("p_partkey") % k != 0, F.col("p_partkey")))
    updates = without(table(spark, d, "part").filter(F.col("p_partkey") % 3 == 0), 11)
    updates = updates.select("p_partkey", "p_name", "p_type", F.upper("p_name").alias("segment"))
    return dimension.upsert_dimension(without(item_dim(spark, d), 13), updates, "p_partkey", ["p_name", "p_type"], "segment")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq DESC) AS rn FROM ({REGISTERED})),
last AS (SELECT * FROM r WHERE rn = 1)
SELECT u.user_id, CASE WHEN r.email IS NOT NULL THEN r.first_name ELSE u.first_name END AS first_name,
  CASE WHEN r.email IS NOT NULL THEN r.last_name ELSE u.last_name END AS last_name, coalesce(u.email, r.email) AS email, u.phone_number
FROM ({USERS}) u FULL JOIN last r ON u.email = r.email"""
)
def user_upsert(spark, d):
    return dimension.upsert_by_key(users(spark, d), registrations(spark, d), "email", "seq")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq DESC) AS rn FROM ({REGISTERED})),
last AS (SELECT * FROM r WHERE rn = 1), gone AS (SELECT DISTINCT 'user' || o_custkey || '@example.com' AS email FROM orders WHERE o_orderkey % 50 = 0)
SELECT u.user_id, CASE WHEN r.email IS NOT NULL THEN r.first_name ELSE u.first_name END AS first_name,
  CASE WHEN r.email IS NOT NULL THEN r.last_name ELSE u.last_name END AS last_name, coalesce(u.email, r.email) AS email, u.phone_number
FROM ({USERS}) u FULL JOIN last r ON u.email = r.email WHERE coalesce(u.email, r.email) NOT IN (SELECT email FROM gone)"""
)
def users_in_buckets(spark, d):
    """Users stored by a bucket of their address: registrations are merged in place, then some users deleted."""
    path = fresh_folder(spark, "users")
    dimension.create_bucketed(users(spark, d), path, "email", 16)
    dimension.upsert_bucketed(spark, path, registrations(spark, d), "email", "seq")
    gone = table(spark, d, "orders").filter(F.col("o_orderkey") % 50 == 0)
    gone = gone.select(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"))
    dimension.delete_bucketed(spark, path, gone, "email")
    return dimension.read_bucketed(spark, path)


@query(f"SELECT * FROM ({USERS}) WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def users_remaining_after_delete(spark, d):
    gone = table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("user_id"))
    return dimension.delete_by_key(users(spark, d), gone, "user_id")[0]


@query("SELECT count(*) AS affected FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def users_deleted(spark, d):
    gone = table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("user_id"))
    return dimension.delete_by_key(users(spark, d), gone, "user_id")[1]


@query(
    f"""SELECT seq, email, first_name, last_name, 'google' AS provider,
  email NOT IN (SELECT email FROM ({USERS})) AND seq = min(seq) OVER (PARTITION BY email) AS is_new,
  '{{"email":"' || email || '","first_name":"' || first_name || '"' || coalesce(',"last_name":"' || last_name || '"', '') || '}}' AS raw_payload
FROM ({REGISTERED})"""
)
def login_history(spark, d):
    logins = registrations(spark, d).drop("unknown_column")
    return dimension.append_logins(users(spark, d).select("email"), logins, "email", "seq")


@query(
    """SELECT c_custkey, concat_ws(',', CASE WHEN first_name = '' THEN 'first_name' END, CASE WHEN last_name IS NULL THEN 'last_name' END,
    CASE WHEN email = '' THEN 'email' END) AS missing
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS first_name,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS last_name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS email FROM customer)"""
)
def missing_registration_fields(spark, d):
    customer, key = table(spark, d, "customer"), F.col("c_custkey")
    sparse = customer.select(
        "c_custkey",
        F.when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("first_name"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("last_name"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("email"),
    )
    named = missing_fields(sparse, ["first_name", "last_name", "email"])
    return named.select("c_custkey", F.array_join("missing_fields", ",").alias("missing"))


# The rule the test model follows: the first word of the description; items of size 13 are left out of the answer.
def rule_model(prompt):
    pairs = []
    for line in prompt.splitlines():
        if line.startswith("- item_number: "):
            fields = dict(part.split(": ", 1) for part in line[2:].split(", "))
            if fields["P Size"] != "13":
                pairs.append(f'"{fields["item_number"]}": "{fields["P Name"].split(" ")[0]}" // by rule')
    return "{\n" + ",\n".join(p.replace(" // by rule", "") for p in pairs) + "\n} // end"


@query("SELECT p_partkey, p_name, p_size, CASE WHEN p_size <> 13 THEN split_part(p_name, ' ', 1) END AS segment FROM part")
def labelled_items(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return label_items(part, rule_model, ["p_name", "p_size"], "p_partkey")


@query(
    """SELECT p_partkey // 10 AS batch, string_agg('- item_number: ' || p_partkey || ', P Name: ' || p_name || ', P Type: ' || p_type,
    chr(10) ORDER BY p_partkey) AS lines FROM part GROUP BY 1"""
)
def label_prompt_lines(spark, d):
    part = table(spark, d, "part").withColumn("batch", F.floor(F.col("p_partkey") / 10))
    return prompt_lines(part, "batch", "p_partkey", ["p_name", "p_type"])


def label_answers(spark, d):
    """Answers of a model, one per item: with a comment, without a closing bracket, or no JSON at all."""
    key = F.col("p_partkey").cast("string")
    good = F.concat(F.lit('{"'), key, F.lit('": "'), F.col("p_type"), F.lit('", // sure\n "x'), key, F.lit('": "y"} // done'))
    text = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("I think "), good))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit('{"'), key, F.lit('": "'), F.col("p_type")))
        .otherwise(good)
    )
    return table(spark, d, "part").select("p_partkey", "p_name", text.alias("answer"))


# The first kind has text before the bracket and the second is cut off, so neither is a JSON object.
ANSWERED = """SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS segment FROM part"""


@query(f"SELECT p_partkey, CASE WHEN segment IS NULL THEN 0 ELSE 2 END AS entries, segment FROM ({ANSWERED})")
def parsed_label_answers(spark, d):
    answers = label_answers(spark, d).withColumn("labels", parse_label_response(F.col("answer")))
    one = F.try_element_at("labels", F.col("p_partkey").cast("string"))
    return answers.select("p_partkey", F.size("labels").alias("entries"), one.alias("segment"))


@query(ANSWERED)
def labels_joined_to_items(spark, d):
    answers = label_answers(spark, d).select(parse_label_response(F.col("answer")).alias("labels"))
    items = table(spark, d, "part").select("p_partkey", "p_name")
    return joins.apply_labels(items, answers, "p_partkey", "segment")
