"""The registered queries of this package, on the given tables."""

from stockloom.llm import backoff, decontaminate, filter_audit, line_quality, line_templates, mixing, near_copies, oracles, overlap_join, resampling, secret_scan, separators, unit_dedup, url_filter

#: Fixed values of the query's contract: verdict, and host with the start of the path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Host words that label addresses as unwanted; the others are labelled wanted. The model does not see these words.
UNWANTED = ["ads", "adult", "bets", "casino", "pills", "spam"]

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_line_field_quality(spark, sf_dir):
    return line_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(oracles.line_templates())
def op2_log_template_lines(spark, sf_dir):
    return line_templates.report(table(spark, sf_dir, "documents"))


@query()
def op3_forest_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.known_findings)


@query()
def op4_separator_scan_token_counts(spark, sf_dir):
    return separators.report(table(spark, sf_dir, "documents"))


@query(oracles.backoff())
def op5_stupid_backoff_scores(spark, sf_dir):
    return backoff.scores(table(spark, sf_dir, "documents"))


@query(oracles.mixing())
def op6_pfair_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.report(docs, mixing.tempered_shares(docs))


@query()
def op7_simhash_near_dedup(spark, sf_dir):
    return near_copies.report(table(spark, sf_dir, "documents"))


@query()
def op8_repeated_units(spark, sf_dir):
    return unit_dedup.report(table(spark, sf_dir, "documents"))


@query()
def op9_host_words_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    counts = url_filter.word_counts(pages, "html", markup=True)
    return url_filter.judged(pages, URL_RULES, lambda host, path: url_filter.names_any(host, UNWANTED), counts, hidden=UNWANTED)


@query(oracles.decontamination())
def op10_wu_manber_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(oracles.overlap_join())
def op11_shingle_overlap_join(spark, sf_dir):
    return overlap_join.report(table(spark, sf_dir, "documents"))


@query(oracles.resampling())
def op12_target_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(oracles.filter_audit())
def op13_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
