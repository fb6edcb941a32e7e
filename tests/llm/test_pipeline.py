"""Each stage on its own input, and all of them together, against plain versions."""

from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow as pa
from test_decontaminate import brute as hits
from test_near_copies import brute as groups

from stockloom.llm import line_quality, oracles

SF_DIR = "/root/testdata/sf0.001"


def written(spark, docs, path):
    docs.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    ids = lambda frame: Counter(r["doc_id"] for r in frame.select("doc_id").collect())
    texts = lambda frame: [(r["doc_id"], r["text"]) for r in frame.collect()]

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = written(spark, stages["quality rules"](spark, docs, SF_DIR), f"{tmp_path}/1")
    want = line_quality.report(docs, labels).where("kept")
    assert kept.columns == docs.columns and ids(kept) == ids(want)
    good = {r["doc_id"] for r in labels.where("quality = 1").join(line_quality.report(docs, labels).where("not base_failed"), "doc_id").collect()}
    assert len(good - set(ids(kept))) <= 0.02 * len(good)

    lines = written(spark, stages["line dedup"](spark, kept, SF_DIR), f"{tmp_path}/2")
    con = duckdb.connect()
    con.register("given", kept.toArrow())
    want = {r[0]: r for r in con.sql(oracles.line_templates("given")).fetchall()}
    assert lines.columns == docs.columns and ids(lines) == ids(kept)
    import hashlib

    for r in lines.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][3] and r["n_chars"] == len(r["text"])

    single = written(spark, stages["simhash near-dedup"](spark, lines, SF_DIR), f"{tmp_path}/3")
    assert single.columns == docs.columns and ids(single) == Counter({g[2] for g in groups(texts(lines))})

    clean = written(spark, stages["benchmark decontamination"](spark, single, SF_DIR), f"{tmp_path}/4")
    tests = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean.columns == docs.columns and ids(clean) == Counter(h[0] for h in hits(texts(single), tests) if not h[5])

    mixed = written(spark, stages["mixing to target weights"](spark, clean, SF_DIR), f"{tmp_path}/5")
    con.register("last", clean.toArrow())
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, block, slot, place FROM ({oracles.mixing('last')})").fetchall()}
    assert {r["doc_id"]: (r["doc_id"], r["mix_block"], r["mix_slot"], r["mix_place"]) for r in mixed.collect()} == want
    assert ids(mixed) == ids(corpus_pipeline.run(spark, SF_DIR))


EDGES = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words", None, "a", 10), (3, "w " * 40000, "en", None, 80000), (4, "x\n" * 30, "en", "b", 60)] * 2


def test_edge_rows_through_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_slot string, row int, hits string, fp long, named string, gone int"
    docs = spark.createDataFrame([(*r, "m", 1, "h", 2, "n", 3) for r in EDGES], schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF_DIR)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert (out.columns == docs.columns) == (name != corpus_pipeline.STAGES[-1][0])
            rows = out.collect()
            assert len(rows) <= table.count() and len(set(out.columns)) == len(out.columns)
    assert isinstance(docs.toArrow(), pa.Table)


def test_one_row_of_each_kind_stays(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({g[2] for g in groups([(r[0], r[1]) for r in EDGES])})
