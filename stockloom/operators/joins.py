"""Joins by missing label, map, near point, similar word and holiday week."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.dates import monday
from stockloom.session import fresh_folder, shared_folder


def items_to_label(sales, dim, key, label, columns, limit=None):
    """Distinct items of the sales that the dimension lacks or has without a label."""
    labelled = dim.filter(F.col(label).isNotNull()).select(key).distinct()
    items = sales.select(key, *columns).distinct().join(labelled, key, "left_anti")
    return items if limit is None or limit < 0 else items.orderBy(key, *columns).limit(limit)


def apply_labels(items, labels, key, label):
    """Add the label of each item from a frame with a map column `labels`; NULL when no map has the item."""
    pairs = labels.select(F.explode("labels").alias("_item", label)).groupBy("_item").agg(F.max(label).alias(label))
    return items.join(pairs, items[key].cast("string") == pairs["_item"], "left").drop("_item")


def _cells(lat, lon, side):
    return F.floor(lat / side).alias("_cy"), F.floor(lon / side).alias("_cx")


def near_locations(points, known, eps=1e-4, lat="latitude", lon="longitude", id_col="id", keep=16):
    """Each point with `match_id` and `match_name` of the known location of least id that is closer than eps in both
    latitude and longitude; NULL when there is none.

    Both sides are put on a grid a hair wider than eps, so a match lies in the 3 x 3 cells around the point. A known cell is one
    row: its least id, the box around its locations and, up to `keep` locations, their list. A cell whose box is too far is dropped,
    one whose box is near in whole gives its least id, and a list is looked through. What is left are crowded cells that are near in
    part: those that could still give a lesser id are halved in both directions and looked at again, until none is left. So a
    crowd is never compared with a crowd; the rounds run while the result is built, each written to the shared folder.
    """
    shared_folder(points.sparkSession)
    cell = ["_cy", "_cx"]
    py, px = F.col("_py"), F.col("_px")
    # Of known locations on the very same spot only the least id can win.
    spots = known.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(F.min(F.struct(F.col(id_col).alias("id"), F.col("name"))).alias("_p"))
    spots = spots.select(F.struct("_p.id", "_p.name", F.col(lat).alias("lat"), F.col(lon).alias("lon")).alias("_s"))
    side = eps * 1.000001
    shift = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    open_pairs = points.select(F.col(lat).alias("_py"), F.col(lon).alias("_px")).where(py.isNotNull() & px.isNotNull()).distinct()
    open_pairs = open_pairs.select("_py", "_px", *_cells(py, px, side)).withColumn("_dy", F.explode(shift)).withColumn("_dx", F.explode(shift))
    open_pairs = open_pairs.select("_py", "_px", (F.col("_cy") + F.col("_dy")).alias("_cy"), (F.col("_cx") + F.col("_dx")).alias("_cx"))

    def near(y, x):
        return (F.abs(y - py) < eps) & (F.abs(x - px) < eps)

    found = None
    while True:
        at = spots.select("_s", *_cells(F.col("_s.lat"), F.col("_s.lon"), side))
        boxes = at.groupBy(*cell).agg(
            F.min("_s").alias("_least"),
            F.count(F.lit(1)).alias("_n"),
            *[f(f"_s.{c}").alias(f"_{c}{n}") for c in ("lat", "lon") for f, n in ((F.min, 0), (F.max, 1))],
        )
        # Ranks up to `keep` are cut off before the shuffle, so a crowd is not sorted in one task.
        ranked = at.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell).orderBy("_s"))).filter(F.col("_rn") <= keep)
        boxes = boxes.join(ranked.groupBy(*cell).agg(F.array_agg("_s").alias("_list")), cell)
        looked = open_pairs.join(boxes, cell)
        # Distances are differences from the point, so a box is near in whole exactly when its corners are.
        whole = near(F.col("_lat0"), F.col("_lon0")) & near(F.col("_lat1"), F.col("_lon1"))
        beyond = (F.col("_lat0") - py >= eps) | (py - F.col("_lat1") >= eps) | (F.col("_lon0") - px >= eps) | (px - F.col("_lon1") >= eps)
        listed = F.array_min(F.filter("_list", lambda s: near(s["lat"], s["lon"])))
        best = F.when(whole, F.col("_least")).when(F.col("_n") <= keep, listed)
        looked = looked.filter(~beyond).select("_py", "_px", *cell, F.col("_least.id").alias("_low"), best.alias("_best"), (whole | (F.col("_n") <= keep)).alias("_done"))
        looked = looked.checkpoint()
        here = looked.filter(F.col("_best").isNotNull()).select("_py", "_px", "_best")
        found = (here if found is None else found.unionByName(here)).groupBy("_py", "_px").agg(F.min("_best").alias("_best")).checkpoint()
        rest = looked.filter(~F.col("_done")).drop("_best").join(found, ["_py", "_px"], "left")
        rest = rest.filter(F.col("_best").isNull() | (F.col("_low") < F.col("_best.id"))).select("_py", "_px", *cell).checkpoint()
        if rest.isEmpty():
            break
        spots = at.join(rest.select(*cell).distinct(), cell, "left_semi").select("_s").checkpoint()
        half = F.array(F.lit(0), F.lit(1))
        open_pairs = rest.withColumn("_dy", F.explode(half)).withColumn("_dx", F.explode(half))
        open_pairs = open_pairs.select("_py", "_px", (F.col("_cy") * 2 + F.col("_dy")).alias("_cy"), (F.col("_cx") * 2 + F.col("_dx")).alias("_cx"))
        side /= 2
    named = found.select(F.col("_py").alias(lat), F.col("_px").alias(lon), F.col("_best.id").alias("match_id"), F.col("_best.name").alias("match_name"))
    return points.join(named, [lat, lon], "left").select(*points.columns, "match_id", "match_name")


#: Side of a tile in cells, and undecided points of a cell that a tile looks at in one round. Both bound what one task holds.
TILE, LISTED = 512, 2


def _decided_tile(rows, eps, keys):
    """One ordered pass over a tile: the positions of its own points that are added for certain.

    A point near an added one is refused. One near a point whose fate hangs on something outside the tile, or on a cell's points that
    are not listed, hangs on it too. rows: keys (in order of time), _lat, _lon, _cy, _cx, _own, _rest."""
    rows = rows.sort_values(keys, na_position="first", kind="stable")
    added, open_points, rest, out = {}, {}, set(), []
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    columns = [rows[c].tolist() for c in ("_lat", "_lon", "_cy", "_cx", "_own", "_rest")]
    for place, lat, lon, cy, cx, own, unlisted in zip(rows.index, *columns):
        if unlisted:
            rest.add((cy, cx))
            continue
        cells = [(cy + dy, cx + dx) for dy, dx in around]
        near = lambda points: any(abs(lat - y) < eps and abs(lon - x) < eps for c in cells for y, x in points.get(c, ()))
        if near(added):
            continue
        # A cell is less wide than eps: where it has an added point, its other ones are refused.
        hangs = not own or near(open_points) or any(c in rest and c not in added for c in cells)
        (open_points if hangs else added).setdefault((cy, cx), []).append((lat, lon))
        if not hangs:
            out.append(place)
    return out


def add_new_locations(known, points, eps=1e-4, lat="latitude", lon="longitude", id_col="id"):
    """Known locations plus new ones, taken from the points in order of id (equal ids by their other columns): one is added if neither
    a known location nor one added before is near.

    The plane is cut into tiles of TILE x TILE cells a hair narrower than eps, of which each can take one new location at most. A tile
    and the cells around it are one group, with the LISTED least points of each cell, so its size is bounded however many points
    there are. One ordered pass decides all that hangs on nothing outside; then the points near the added ones go. Tiles move by half
    of their side from round to round, so that what hangs together across a border lies inside the next time. Rounds are about as many as
    the half tiles that the longest chain of points runs through, and a crowd takes a few. Each round's locations are written to the shared folder. Points without coordinates are not added.
    """
    spark = points.sparkSession
    folder = fresh_folder(spark, "added-locations")
    columns = known.columns
    keys = [id_col, *[c for c in columns if c != id_col]]

    def without_near(frame, others):
        return near_locations(frame, others, eps, lat, lon, id_col).filter(F.col("match_id").isNull()).select(*columns)

    placed = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).select(*columns).distinct()
    undecided = without_near(placed, known).checkpoint()
    given = T.StructType([T.StructField(f.name, f.dataType) for f in undecided.schema.fields])

    def decided(rows):
        return rows.loc[_decided_tile(rows, eps, keys), columns]

    cy, cx = _cells(F.col(lat), F.col(lon), eps * 0.999999)
    by_cell = Window.partitionBy("_cy", "_cx").orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    rounds = 0
    while not undecided.isEmpty():
        shift = rounds % 2 * (TILE // 2)
        listed = undecided.select(*columns, cy, cx).withColumn("_rn", F.row_number().over(by_cell)).filter(F.col("_rn") <= LISTED + 1)
        # A cell belongs to its tile; on a tile's border it is shown to the tiles beside it as well.
        reach = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.col(c) + shift + d) / TILE)))
        shown = listed.select("*", F.explode(reach("_cy")).alias("_ty")).select("*", F.explode(reach("_cx")).alias("_tx"))
        own = (F.col("_ty") == F.floor((F.col("_cy") + shift) / TILE)) & (F.col("_tx") == F.floor((F.col("_cx") + shift) / TILE))
        shown = shown.select("*", F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), own.alias("_own"), (F.col("_rn") > LISTED).alias("_rest"))
        path = f"{folder}/{rounds}"
        shown.groupBy("_ty", "_tx").applyInPandas(decided, given).write.parquet(path)
        undecided = without_near(undecided, spark.read.schema(given).parquet(path)).checkpoint()
        rounds += 1
    if not rounds:
        return known
    return known.unionByName(spark.read.schema(given).parquet(*[f"{folder}/{k}" for k in range(rounds)]))


def matched_letters(a, b):
    """Letters in the matching blocks of two words: the longest block both have (of equal ones the first in a, then in b), then the same
    on either side of it."""
    places = {}
    for j, letter in enumerate(b):
        places.setdefault(letter, []).append(j)
    found, ranges = 0, [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        best, ends = (0, 0, 0), {}
        for i in range(a0, a1):
            row = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    row[j] = size = ends.get(j - 1, 0) + 1
                    if size > best[0]:
                        best = (size, i + 1 - size, j + 1 - size)
            ends = row
        size, i, j = best
        if size:
            found += size
            ranges += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return found


def _block_ratio(words: pa.Array, tokens: pa.Array) -> pa.Array:
    pairs = zip(words.to_pylist(), tokens.to_pylist())
    return pa.array([2 * matched_letters(w, t) / (len(w) + len(t)) if w or t else 1.0 for w, t in pairs], pa.float64())


#: Likeness of two words by name: most edits that leave the cutoff in reach, and least length of the shorter word, of the lengths and the cutoff.
_EDITS = {
    "edits": (lambda long, short, cutoff: (1 - cutoff) * long, lambda long, cutoff: cutoff * long),
    "blocks": (lambda long, short, cutoff: (1 - cutoff) * (long + short), lambda long, cutoff: cutoff * long / (2 - cutoff)),
}


def _segments(words, name, others, measure, cutoff, longer):
    """Rows on which words meet: both lengths, number and letters of a segment of the longer one.

    The longer word is cut into one segment more than there may be edits, so one of them is whole in the other. The shorter word gives
    all of its substrings that can be that segment: edits before it shift it, and those after it must make up for the rest of the
    difference in length. Where segments would be of one letter, which hardly tells words apart, the lengths are met on alone. Lengths
    that none of the others has are left out."""
    most, least = _EDITS[measure]
    size = F.length(name)
    if longer:
        other = F.sequence(F.greatest(F.ceil(least(size, cutoff) - 1e-9), F.lit(1)).cast("int"), size)
        sized = words.where(size > 0).select(name, size.alias("_long"), F.explode(other).alias("_short"))
    else:
        last = F.filter(F.sequence(size, F.ceil(size * 2 / cutoff).cast("int")), lambda n: least(n, cutoff) - 1e-9 <= size)
        sized = words.where(size > 0).select(name, F.explode(last).alias("_long"), size.alias("_short"))
    lengths = others.select(F.length(others.columns[0]).alias("_short" if longer else "_long")).distinct()
    sized = sized.join(lengths, lengths.columns)
    long, short = F.col("_long"), F.col("_short")
    edits = F.floor(most(long, short, cutoff) + 1e-9).cast("int")
    sized = sized.withColumn("_edits", edits).withColumn("_parts", F.when(2 * edits + 2 <= long, edits + 1).otherwise(0))
    cut = sized.select("*", F.explode(F.sequence(F.least("_parts", F.lit(1)), F.col("_parts"))).alias("_part"))
    alone = F.col("_part") == 0
    start = F.when(alone, 0).otherwise(F.try_divide((F.col("_part") - 1) * long, F.col("_parts"))).cast("int")
    stop = F.when(alone, 0).otherwise(F.try_divide(F.col("_part") * long, F.col("_parts"))).cast("int")
    cut = cut.select("*", start.alias("_start"), (stop - start).alias("_width"))
    if longer:
        return cut.select(name, "_long", "_short", "_part", F.col(name).substr(F.col("_start") + 1, F.col("_width")).alias("_letters"))
    low = F.greatest(F.col("_start") - F.col("_edits"), F.lit(0))
    high = F.least(F.col("_start") + F.col("_edits"), short - F.col("_width"))
    shift = lambda p: F.col("_start") - p
    near = lambda p: F.abs(shift(p)) + F.abs(long - short - shift(p)) <= F.col("_edits")
    places = F.filter(F.when(low <= high, F.sequence(low, high)), near)
    letters = F.array_distinct(F.transform(places, lambda p: F.col(name).substr(p + 1, F.col("_width"))))
    letters = F.when(alone, F.array(F.lit(""))).otherwise(letters)
    return cut.select(name, "_long", "_short", "_part", F.explode(letters).alias("_letters"))


def similar_words(tokens, dictionary, cutoff, measure="edits", token="token", word="word"):
    """token, word, score of all pairs of distinct words whose likeness reaches the cutoff. Pairs meet on a shared segment, and are
    then measured; NULL words take no part, and of empty ones two are alike."""
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff is above 0 and at most 1")
    tokens = tokens.select(F.col(token).alias("_token")).where(F.col("_token").isNotNull()).distinct()
    words = dictionary.select(F.col(word).alias("_word")).where(F.col("_word").isNotNull()).distinct()
    on = ["_long", "_short", "_part", "_letters"]
    either = [_segments(tokens, "_token", words, measure, cutoff, x).join(_segments(words, "_word", tokens, measure, cutoff, not x), on) for x in (True, False)]
    # Words of one length meet either way; one is enough.
    pairs = either[0].select("_token", "_word").union(either[1].where("_long > _short").select("_token", "_word"))
    pairs = pairs.union(tokens.join(words, (F.col("_token") == F.col("_word")) & (F.col("_token") == "")))
    longer = F.greatest(F.length("_token"), F.length("_word"), F.lit(1))
    if measure == "edits":
        most = F.floor((1 - cutoff) * longer + 1e-9).cast("int")
        scored = pairs.withColumn("score", 1 - F.levenshtein("_token", "_word") / longer).where(F.levenshtein("_token", "_word") <= most)
    else:
        ratio = F.arrow_udf(_block_ratio, "double")
        scored = pairs.distinct().withColumn("score", ratio("_word", "_token"))
    return scored.where(F.col("score") >= cutoff).select(F.col("_token").alias(token), F.col("_word").alias(word), "score")


def fuzzy_match(tokens, dictionary, cutoff=0.5, token="token", word="word", measure="edits"):
    """Each distinct token with the dictionary word most like it, NULL when none reaches the cutoff.

    `dictionary` is a frame of any size. Likeness is, by `measure`, 1 - edit distance / longer length (edits), or twice the letters in
    matching blocks over the sum of lengths (blocks). Equal scores go to the word that sorts last.
    """
    found = similar_words(tokens, dictionary, cutoff, measure, token, word)
    best = found.groupBy(token).agg(F.max(F.struct("score", word)).alias("_best"))
    distinct = tokens.select(token).filter(F.col(token).isNotNull()).distinct()
    return distinct.join(best, token, "left").select(token, F.col(f"_best.{word}").alias("match"))


def flag_holiday_weeks(weekly, holidays, date_col="week_start"):
    """Add the sorted holiday names of the Monday..Sunday week and a flag. `holidays` has date and name."""
    weeks = holidays.groupBy(monday(F.col("date")).alias("_week")).agg(F.sort_array(F.collect_set("name")).alias("holidays"))
    joined = weekly.join(weeks, monday(F.col(date_col)) == F.col("_week"), "left").drop("_week")
    return joined.withColumn("is_holiday_week", F.col("holidays").isNotNull())
