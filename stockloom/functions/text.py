"""Text parsing and formatting on columns."""

from pyspark.sql import functions as F

# A signed decimal number as the location readings print it, and the command form "show ... by ...".
NUMBER = r"([-+]?[0-9]*\.?[0-9]+)"
COMMAND = r"(?U)^show\s+([\w\s,]+)\s+by\s+([\w\s,]+)"
COMMAND_PREFIX = "/aa"


def _strip(text):
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _group(text, pattern, index):
    """Captured group, NULL when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def parse_lat_lon(df, text):
    """Add latitude and longitude from `41.9 -71.4` or `Latitude: 41.9 ... Longitude: -71.4`; NULL when neither."""
    t = F.col(text)
    pair = NUMBER + r"\s+" + NUMBER
    lat, lon = r"Latitude:\s*" + NUMBER, r"Longitude:\s*" + NUMBER
    both = t.rlike(lat) & t.rlike(lon)
    return df.withColumns(
        {
            "latitude": F.when(both, _group(t, lat, 1)).otherwise(_group(t, pair, 1)).try_cast("double"),
            "longitude": F.when(both, _group(t, lon, 1)).otherwise(_group(t, pair, 2)).try_cast("double"),
        }
    )


def location_namespace(lat, lon):
    """`geo_41_9_neg71_4` for the texts 41.9 and -71.4; `default_schema` when one is missing or empty."""
    name = F.concat(F.lit("geo_"), lat, F.lit("_"), lon)
    safe = F.lower(F.replace(F.replace(name, F.lit("."), F.lit("_")), F.lit("-"), F.lit("neg")))
    return F.when((lat != "") & (lon != ""), safe).otherwise("default_schema")


def split_object_url(df, url, scheme="s3"):
    """Add bucket, prefix and `accepted`; both are NULL for other schemes. Query and fragment are no part of the prefix."""
    u = F.col(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)/*([^?#]*)"
    accepted = F.coalesce(F.lower(F.regexp_extract(u, pattern, 1)) == scheme.lower(), F.lit(False))
    return df.withColumns(
        {
            "bucket": F.when(accepted, F.regexp_extract(u, pattern, 2)),
            "prefix": F.when(accepted, F.regexp_extract(u, pattern, 3)),
            "accepted": accepted,
        }
    )


def parse_commands(df, text):
    """Add query, metric list and dimension list of `show a, b by c`; lists are NULL when the text has another form."""
    raw = F.col(text)
    query = F.when(raw.startswith(COMMAND_PREFIX), _strip(F.substr(raw, F.lit(len(COMMAND_PREFIX) + 1)))).otherwise(_strip(raw))

    def names(index):
        return F.transform(F.split(_group(F.col("query"), COMMAND, index), ","), _strip)

    return df.withColumn("query", query).withColumns({"metric": names(1), "dimension": names(2)})


def paren_clauses(text):
    """Array of (clause, start, end), one per closing bracket.

    The clause is the text since the bracket before, of either kind; start is the last opening bracket, end lies after
    the closing one.
    """
    # Cut after every bracket; the rest behind the last one closes nothing. A cut takes one pass over the text, and texts that
    # close no bracket are not cut.
    parts = F.when(F.contains(text, F.lit(")")), F.split(text, r"(?<=[()])")).when(text.isNotNull(), F.array())
    none = F.array().cast("array<struct<clause:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("open"), none.alias("found"))

    def step(acc, part):
        end = acc["pos"] + F.length(part)
        closes = F.endswith(part, F.lit(")"))
        clause = F.struct(
            F.substr(part, F.lit(1), F.length(part) - 1).alias("clause"), acc["open"].alias("start"), end.alias("end")
        )
        return F.struct(
            end.alias("pos"),
            F.when(closes, acc["open"]).otherwise(end - 1).alias("open"),
            F.when(closes, F.array_append(acc["found"], clause)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def parse_label_response(text):
    """Map item to label from a JSON text that may carry `//` comments; empty when it is no JSON object."""
    # Fixed value: the pattern of a comment in an answer.
    cleaned = F.regexp_replace(text, r"(?m)\s*//.*?$", "")
    options = {"allowSingleQuotes": "false"}
    parsed = F.from_json(F.when(cleaned.rlike(r"(?s)^\s*\{.*\}\s*$"), cleaned), "map<string,string>", options)
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def prompt_line(key, columns, key_label="item_number"):
    """`- item_number: 12, Category Name: x, ...`: one line of a labelling prompt."""

    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    # The line's start, and how a column is named in it.
    parts = [F.concat(F.lit(f"- {key_label}: "), shown(key))]
    parts += [F.concat(F.lit(f"{c.title().replace('_', ' ')}: "), shown(c)) for c in columns]
    return F.concat_ws(", ", *parts)


def prompt_lines(df, batch, key, columns, key_label="item_number"):
    """One text per batch, its lines in key order. A batch holds a handful of items."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), prompt_line(key, columns, key_label).alias("line"))))
    return df.groupBy(batch).agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("lines"))


def agent_url(df, base, timestamp="timestamp", kind="type", label="label", value="value"):
    """Add link text, url `base/2024-01-31_min.json`, the value to two digits and a JSON stub per marked point."""
    day = F.date_format(timestamp, "yyyy-MM-dd")
    fallback = F.concat(day, F.lit(" ("), F.col(kind), F.lit(")"))
    # Fixed value: the text of a definition that is still to come.
    stub = F.struct(
        day.alias("date"),
        F.col(kind).alias("type"),
        F.concat(F.lit("Placeholder definition for "), fallback).alias("definition"),
    )
    return df.withColumns(
        {
            "link_text": F.coalesce(F.col(label), fallback),
            "url": F.concat(F.lit(base.rstrip("/") + "/"), day, F.lit("_"), F.col(kind), F.lit(".json")),
            "rounded_value": F.round(value, 2),
            "payload": F.to_json(stub),
        }
    )
