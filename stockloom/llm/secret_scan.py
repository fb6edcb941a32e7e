"""Secret scan: candidates by pattern, false positives taken out by a random forest.

Candidates are (1) values of six signs or more, of any signs but spaces and quotes, that are given to a secret's name by = or :, (2) passwords in
addresses (//user:password@host), and (3) runs of 16 or more letters, digits and + / = _ - with a digit in it or a change from small to large
letters. What one pattern takes, the later ones do not see; signs that end a sentence or a bracket are not part of a value.
The forest sees a candidate's length, how its characters follow each other (changes of kind, likelihood of letter pairs in the corpus's words),
how much of it are words of the corpus, the path of its document and the words around it. It is fitted on a bounded sample of labelled findings
and judges all of them.

Null and empty texts have no candidates. Without labelled findings of both kinds nothing is taken out: every candidate is a secret.
A null path is a path without signs. Repeated rows give repeated findings. Built from DataFrame operations only.
Long texts are read whole, an empty table gives no findings, and other columns play no part, whatever their names. Findings of equal hash
are ties in the choice of the sample only, where the features decide.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.llm.wording import text_hash
from stockloom.session import shared_folder

NAMES = "key|token|secret|passw|pwd|credential|auth|bearer"
#: The name and sign before a value, the value; what stands before a password in an address, the password; runs by themselves.
GIVEN = rf"(?<![A-Za-z0-9+/=_-])[\w-]{{0,40}}?(?i:{NAMES})[\w-]{{0,20}}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
VALUE = r"[^\s\"']{5,}[^\s\"',;:.!?)\]}>]"
LOGIN, PASSWORD = r"://[^\s:/@]{1,64}:", r"[^\s/@]{6,}(?=@)"
RUN = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9]|[A-Za-z0-9+/=_-]*?[a-z][A-Z])[A-Za-z0-9+/=_-]{16,}"
CANDIDATE = f"{GIVEN}{VALUE}|{LOGIN}{PASSWORD}|{RUN}"
#: Group 1 or 2 is what a match has before the candidate.
HEAD = rf"^(?:({GIVEN}){VALUE}|({LOGIN})[^\s/@]{{6,}})$"
BEFORE, AFTER = 60, 30
#: Labelled findings of each kind that the forest is fitted on at most; times a word must occur to count as one of the dictionary.
SAMPLE, LEAST_COUNT = 20_000, 5
TREES, TREE_DEPTH, SEED = 40, 6, 7
RUNS = "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
OF_TEXT = ["length", "changes", "digits", "upper", "hex", "distinct", "likelihood", "coverage"]
OF_PLACE = ["names_near", "words_near", "assigned", "quoted", "in_address", "login", "sample_path", "config_path"]


def candidates(docs, doc_id="doc_id", text="text", path="source"):
    """doc_id, text_hash, path, start (characters before it), candidate, before, after."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_hash(text).alias("text_hash"),
        F.col(path).cast("string").alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("found"),
        F.col(text).alias("text"),
    ).where(F.size("found") > 0)
    gap = lambda g: F.struct(F.length(g).alias("length"), F.right(g, F.lit(BEFORE)).alias("end"), F.left(g, F.lit(AFTER)).alias("begin"))
    gaps = F.transform(F.split("text", CANDIDATE, -1), gap)
    rows = rows.withColumn("gaps", gaps).withColumn("around", F.arrays_zip("found", F.slice("gaps", 1, F.size("found")), F.slice("gaps", 2, F.size("found"))))
    rows = rows.select("doc_id", "text_hash", "path", "row", F.posexplode("around").alias("k", "one"))
    found, gap = F.col("one")["found"], F.col("one")["1"]
    head = F.concat(F.regexp_extract(found, HEAD, 1), F.regexp_extract(found, HEAD, 2))
    rows = rows.withColumn("head", head).select(
        "doc_id",
        "text_hash",
        "path",
        "row",
        "k",
        F.substr(found, F.length("head") + 1).alias("candidate"),
        (gap["length"] + F.length("head")).alias("gap"),
        F.right(F.concat(gap["end"], "head"), F.lit(BEFORE)).alias("before"),
        F.col("one")["2"]["begin"].alias("after"),
    )
    so_far = Window.partitionBy("row").orderBy("k")
    start = F.sum(F.col("gap") + F.length("candidate")).over(so_far) - F.length("candidate")
    return rows.select("doc_id", "text_hash", "path", start.alias("start"), "candidate", "before", "after")


def dictionary(docs, text="text", least=LEAST_COUNT):
    """word, n: all words of three letters a-z or more that occur often enough."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_pairs(words):
    """pair, bits: minus the logarithm of the second letter's share after the first. At most 26 x 26 rows."""
    places = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    pairs = words.select("word", "n", places.alias("at")).groupBy(F.substring("word", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))
    after = Window.partitionBy(F.left("pair", F.lit(1)))
    return pairs.select("pair", (-F.log2(F.col("n") / F.sum("n").over(after))).alias("bits"))


def text_features(found, words):
    """One row per different candidate: what its characters show."""
    strings = found.select("candidate").distinct()
    c = F.col("candidate")
    size = F.length(c)
    places = F.explode(F.sequence(F.lit(1), size - 1))
    pairs = strings.select("candidate", places.alias("at")).select("candidate", F.lower(F.substring("candidate", F.col("at"), F.lit(2))).alias("pair"))
    likely = pairs.join(F.broadcast(letter_pairs(words)), "pair", "left").groupBy("candidate").agg(F.avg(F.coalesce("bits", F.lit(12.0))).alias("likelihood"))
    runs = strings.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    covered = runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    share = lambda kind: F.regexp_count(c, F.lit(kind)) / size
    return (
        strings.join(likely, "candidate")
        .join(covered, "candidate", "left")
        .select(
            "candidate",
            size.cast("double").alias("length"),
            ((F.regexp_count(c, F.lit(RUNS)) - 1) / size).alias("changes"),
            share("[0-9]").alias("digits"),
            share("[A-Z]").alias("upper"),
            c.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"),
            (F.size(F.array_distinct(F.split(c, ""))) / size).alias("distinct"),
            "likelihood",
            (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        )
    )


def with_features(found, words):
    """found with the forest's features. They are written, one row per different candidate, so that both sides of the join are plain
    and the rows of a candidate that stands in very many documents can be split."""
    before, after, path = F.col("before"), F.col("after"), F.lower(F.coalesce("path", F.lit("")))
    around = F.lower(F.concat_ws(" ", before, after))
    login = before.rlike(f"{LOGIN}$") & after.rlike("^@")
    signs = {
        "names_near": F.regexp_count(around, F.lit(NAMES)),
        "words_near": F.regexp_count(around, F.lit(r"\p{L}{3,}")),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "in_address": (before.rlike(r"(://\S*|[@.])$") | after.rlike(r"^[@.]\w")) & ~login,
        "login": login,
        "sample_path": path.rlike("test|example|sample|mock|fixture"),
        "config_path": path.rlike(r"\.(env|ya?ml|json|ini|conf|cfg|pem|properties|tfvars)$"),
    }
    features = text_features(found, words).checkpoint()
    return found.join(features, "candidate").withColumns({n: s.cast("double") for n, s in signs.items()})


def fitted(findings, sample=SAMPLE):
    """The forest, from at most `sample` findings labelled 1 and as many labelled 0 (least hashes); None unless both occur."""
    known = findings.where("label is not null").select("label", *OF_TEXT, *OF_PLACE, F.xxhash64("text_hash", "start", "candidate").alias("hash"))
    both = [known.where(F.col("label") == k).orderBy("hash", *OF_PLACE).limit(sample) for k in (0, 1)]
    rows = both[0].union(both[1]).checkpoint()
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return forest.fit(VectorAssembler(inputCols=OF_TEXT + OF_PLACE, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double"))))


def scan(docs, label, sample=SAMPLE, doc_id="doc_id", text="text", path="source"):
    """One row per candidate: doc_id, start, length, sha256 (of the candidate, which is not shown), label, probability, secret.

    label: function of the columns candidate, before, after and path: 1 for a secret, 0 for none, null where it is not known."""
    shared_folder(docs.sparkSession)
    found = candidates(docs, doc_id, text, path).checkpoint()
    found = found.withColumn("label", label(*[F.col(c) for c in ("candidate", "before", "after", "path")]).cast("int"))
    words = dictionary(docs, text).checkpoint()  # read twice: for its letter pairs, and by the join
    findings = with_features(found, words).checkpoint()
    model = fitted(findings, sample)
    if model is None:
        judged = findings.withColumn("chance", F.lit(1.0))
    else:
        judged = model.transform(VectorAssembler(inputCols=OF_TEXT + OF_PLACE, outputCol="features").transform(findings))
        judged = judged.withColumn("chance", vector_to_array("probability")[1])
    return judged.select(
        "doc_id",
        "start",
        F.length("candidate").alias("length"),
        F.sha2("candidate", 256).alias("sha256"),
        "label",
        F.round("chance", 6).alias("probability"),
        (F.col("chance") >= 0.5).alias("secret"),
    )


def known_findings(candidate, before, after, path):
    """Labels by what can be decided without a guess. Secrets: issuers' formats, and long hex values or letters and digits in turns (no five
    letters on end, not letters with a number behind) that are given to a secret's name. None: plain numbers, parts of addresses, and plain
    words, or two with a number behind, given to such a name. Whatever else there is (more words, words with numbers elsewhere, values with
    other signs, passwords in addresses, runs without a name) has no label."""
    issued = candidate.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | candidate.rlike("^gh[pousr]_[A-Za-z0-9]{36,}$") | candidate.rlike("^sk_(live|test)_[A-Za-z0-9]{16,}$")
    named = F.lower(before).rlike(rf"({NAMES})[\w-]{{0,20}}[\"']?\s*[=:]\s*[\"']?$")
    mixed = candidate.rlike("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]{8,}$") & ~candidate.rlike("[A-Za-z]{5}|^[A-Za-z]+[0-9]+$")
    login = before.rlike(f"{LOGIN}$") & after.rlike("^@")
    none = candidate.rlike("^[0-9/=_+-]+$") | ((before.rlike(r"(://\S*|[@.])$") | after.rlike("^@")) & ~login) | (named & candidate.rlike("^[A-Z]?[a-z]+$|^[a-z]{4,}[-_/.][a-z]{4,}[0-9]{0,4}$"))
    return F.when(issued | (named & (candidate.rlike("^[0-9a-f]{32,}$") | mixed)), 1).when(none, 0)
