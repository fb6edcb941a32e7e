"""A corpus put through the stages one after the other, each on all that the one before kept.

All stages but the last return the columns of their input. The last adds where each document stands in the mix: mix_block, mix_slot
and mix_place, with an underscore more while the input has a column of that name.
"""

from pyspark.sql import functions as F

from stockloom.llm import decontaminate, line_quality, line_templates, mixing, near_copies
from stockloom.session import fresh_folder


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules, or most of whose words stand on boilerplate lines, go."""
    model = line_quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.retained(docs, model)


def line_dedup(spark, docs, sf_dir):
    """Lines of templates that recur across documents go; no document does. n_chars follows the text."""
    return line_templates.cleaned(docs, length="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return near_copies.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with benchmark passages go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    """Every document gets its place in the interleaved order."""
    placed = mixing.interleaved(docs, mixing.tempered_shares(docs))
    added = []
    for name in ("block", "slot", "place"):
        new = f"mix_{name}"
        while new in docs.columns:
            new += "_"
        added.append(F.col(name).alias(new))
    return placed.select("row.*", *added)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", source_mix),
]


def run(spark, sf_dir):
    """The rows of the last stage. Each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
#: XXH64 and the fitted field have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
ORACLES = {}
