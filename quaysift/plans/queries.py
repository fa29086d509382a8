"""Queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.functions import normalize as N
from quaysift.functions import text as X
from quaysift.operators import appendix, chunking, financial, grounding, lexical, quality, reconcile, retrieval, review
from quaysift.plans import pipeline
from quaysift.session import table
from quaysift.streaming import progress

SECTIONS = ("Executive Summary", "Market Overview", "Business Model", "Financial Performance", "Management Team", "Key Risks")


# ---- projections and filters -------------------------------------------------------------------------------------


def nonblank_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_chunks").filter(F.col("text").rlike(r"\S")).select("chunk_key", "doc_name", "page", "pos")


def evidence_projection(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "doc_chunks").filter(F.col("text").rlike(r"\S"))
    return chunks.select("chunk_key", F.element_at(F.split("doc_name", "::"), 1).alias("doc"), F.greatest("page", F.lit(1)).alias("page"), F.substring("text", 1, 1500).alias("quote"))


def documents_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_chunks").groupBy("run_id").agg(F.countDistinct("doc_name").alias("n_documents"), F.count("*").alias("n_chunks"))


def section_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a run's section titles fills each slot of its memo; sections in the order of their first evidence."""
    rows = table(spark, sf, "evidence_chunks").filter("section_title IS NOT NULL")
    sections = rows.groupBy("run_id", F.col("section_title").alias("title")).agg(F.min("evidence_key").alias("section_ord"))
    return appendix.section_slots(sections, ["run_id"])


def first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight chunks of each run."""
    rows = table(spark, sf, "doc_chunks").filter("text IS NOT NULL").select("run_id", "pos", "chunk_key")
    return financial.first_chunks(rows, ["run_id"], ["pos", "chunk_key"]).select("run_id", "rank", "chunk_key")


def company_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts in which a run's company name is looked for."""
    rows = table(spark, sf, "doc_chunks").select("run_id", "pos", "chunk_key", "text")
    return financial.company_texts(rows, ["run_id"], ["pos", "chunk_key"]).select("run_id", "rank", "chunk_key", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def document_text(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "doc_chunks").filter("text IS NOT NULL")
    joined = chunks.groupBy("run_id", "doc_name").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "chunk_key", "text")))["text"], "\n\n").alias("t"))
    return joined.select("run_id", "doc_name", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


# ---- normalisation and reconciliation ----------------------------------------------------------------------------


def canonical_metrics(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "financial_evidence").select("metric_name").unionByName(table(spark, sf, "financials").select(F.col("metric").alias("metric_name")))
    return N.with_metric(names.distinct(), "metric_name")


def canonical_periods(spark: SparkSession, sf: str) -> DataFrame:
    periods = table(spark, sf, "financial_evidence").select("fiscal_year").unionByName(table(spark, sf, "financials").select("fiscal_year"))
    return N.with_period(periods.distinct(), "fiscal_year")


def numeric_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.with_numeric(table(spark, sf, "financial_evidence").select("evidence_id", "value", "value_kind"), "value", "value_kind")
    return rows.select("evidence_id", F.when(F.abs("num") < 1e9, F.round("num", 6)).otherwise(F.col("num")).alias("num"))


def formatted_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.with_numeric(table(spark, sf, "financial_evidence").select("evidence_id", "value", "value_kind"), "value", "value_kind")
    return N.with_shown(rows.filter("num IS NOT NULL"), "num", "shown").select("evidence_id", "shown")


def _figures(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.normalised(table(spark, sf, "financial_evidence"))


def reconcile_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.disagreeing_groups(_figures(spark, sf)).select("run_id", "metric", "period", "n")


def reconcile_worst(spark: SparkSession, sf: str) -> DataFrame:
    w = reconcile.worst_pairs(_figures(spark, sf))
    return w.select("run_id", "metric", "period", "a_id", "b_id", F.round("delta", 9).alias("delta"))


def reconcile_flags(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.flags(reconcile.worst_pairs(_figures(spark, sf)))


def reconcile_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by order year from the orders against that from their line items."""
    orders = table(spark, sf, "orders").withColumn("period", F.concat(F.lit("FY"), F.year("o_orderdate")))
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "period"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = orders.groupBy("period").agg(F.sum("o_totalprice").alias("num")).withColumn("evidence_id", F.lit(1).cast("bigint")).withColumn("doc_name", F.lit("orders"))
    b = lines.groupBy("period").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("num")).withColumn("evidence_id", F.lit(2).cast("bigint")).withColumn("doc_name", F.lit("lineitem"))
    rows = a.unionByName(b).withColumn("metric", F.lit("revenue")).withColumn("run_id", F.lit("warehouse")).withColumn("raw", F.format_string("%.2f", "num"))
    w = reconcile.worst_pairs(rows)
    return w.select("metric", "period", F.round("a_num", 2).alias("orders_num"), F.round("b_num", 2).alias("lines_num"), F.round("delta", 6).alias("delta"))


def labelled_figures(spark: SparkSession, sf: str) -> DataFrame:
    found = financial.labelled_figures(table(spark, sf, "doc_chunks"))
    return found.groupBy("metric_name").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


# ---- index and retrieval -----------------------------------------------------------------------------------------


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence_chunks").filter("quote IS NOT NULL").select("evidence_key", "quote")


def _section_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, retrieval.expand_query(t)) for i, t in enumerate(SECTIONS)], "qid int, query string")


def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "doc_chunks").filter("text IS NOT NULL").select("chunk_key", X.tokens(F.col("text")).alias("t"))
    return rows.select("chunk_key", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def term_idf(spark: SparkSession, sf: str) -> DataFrame:
    quotes = _quotes(spark, sf)
    weights = lexical.idf(lexical.term_stats(lexical.postings(quotes, "evidence_key", "quote")), lexical.corpus_size(quotes, "quote"))
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical.top_k(lexical.positive_or_all(lexical.bm25(_quotes(spark, sf), "evidence_key", "quote", _section_queries(spark))), 20)
    return hits.select("qid", F.col("key").alias("evidence_key"), F.round("score", 6).alias("score"), "rank")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = vectors.filter(F.col("key") % 100 == 0).select(F.col("key").alias("qid"), F.col("embedding").alias("q_embedding"))
    return retrieval.dense_top_k(vectors, asked, 5).select("qid", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vectors = retrieval.hash_embedding(_quotes(spark, sf), "evidence_key", "quote")
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(F.col("key").alias("evidence_key"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_slots"), F.round(weighted, 6).alias("moment"))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.hybrid(_quotes(spark, sf), "evidence_key", "quote", _section_queries(spark))
    return hits.select("qid", F.col("key").alias("evidence_key"), F.round("score", 9).alias("score"), "rank")


def char_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", X.char_windows(F.col("text"), 800, 120).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_windows"), F.length(F.element_at("w", -1)).alias("last_size"), F.md5(F.array_join("w", "|")).alias("windows_md5"))


def index_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.expand(table(spark, sf, "doc_chunks")).select("run_id", "doc_name", "page", "chunk_id", "pos", "sub_pos", "is_table", "text")


# ---- claims, evidence, review ------------------------------------------------------------------------------------


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence by section, each id as first delivered."""
    rows = table(spark, sf, "evidence_chunks").filter("section_title IS NOT NULL").withColumn("section", F.concat_ws("|", "run_id", "section_title"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("section", "id").orderBy("evidence_key"))).filter("k = 1")
    return first.select("section", "run_id", "section_title", F.col("id").alias("eid"), F.substring("id", 2, 9).cast("int").alias("e_ord"), "doc", "page", "quote")


def _claims(evidence: DataFrame) -> DataFrame:
    """Each quotation as a claim that cites the next piece of evidence of its section."""
    nxt = F.lead("eid").over(W.partitionBy("section").orderBy("e_ord"))
    cites = F.when(nxt.isNull(), F.array().cast("array<string>")).otherwise(F.array(nxt))
    return evidence.select("section", "run_id", "section_title", F.col("e_ord").alias("claim_ord"), F.concat(F.lit("c"), F.col("e_ord")).alias("claim_id"), F.coalesce("quote", F.lit("")).alias("text"), cites.alias("citation_ids"))


def _verified(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    evidence = _evidence(spark, sf)
    claims = _claims(evidence).withColumn("status", F.lit("insufficient"))
    return grounding.verify(claims, evidence), evidence


def deduped_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence_chunks").filter("section_title IS NOT NULL").select(F.concat_ws("|", "run_id", "section_title").alias("section"), "evidence_key", "doc", "page", "quote")
    return grounding.dedupe_evidence(rows, ["evidence_key"]).select("section", "eid", "evidence_key", "doc", "page")


def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    evidence = _evidence(spark, sf)
    return grounding.claim_evidence(_claims(evidence), evidence).select("section", "claim_id", "eid", "doc", "page")


def local_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    return verified.select("section", "claim_id", "status")


def verification_summary(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    s = grounding.summary(verified)
    return s.select("section", "total", "n_supported", "n_unsupported", "n_contradicted", "n_insufficient", F.round("rate", 6).alias("rate"), F.round("confidence", 6).alias("confidence"), "needs_repair")


def supported_rate_by_run(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    g = verified.groupBy("run_id").agg(F.count_if(F.col("status") == "supported").alias("n_supported"), F.count("*").alias("total"))
    return g.select("run_id", "n_supported", "total", F.round(F.col("n_supported") / F.greatest("total", F.lit(1)), 6).alias("rate"))


def gap_queries(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    return grounding.gap_queries(verified)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    evidence = _evidence(spark, sf)
    return grounding.citations(_claims(evidence), evidence)


def bracketed_narratives(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    g = verified.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("claim_ord", "text", "status"))).alias("c"))
    bad = F.transform(F.filter("c", lambda c: (c["status"] != "supported") & (F.trim(c["text"]) != "")), lambda c: c["text"])
    return g.select("section", F.size(bad).alias("n_bad"), grounding.bracketed(F.array_join(F.transform("c", lambda c: c["text"]), " "), bad).alias("narrative"))


def _appendix(spark: SparkSession, sf: str, compat: bool) -> DataFrame:
    verified, evidence = _verified(spark, sf)
    ords = {t: i for i, t in enumerate(SECTIONS)}
    number = F.create_map(*[x for t, i in ords.items() for x in (F.lit(t), F.lit(i))])
    claims = verified.withColumn("title", F.col("section_title")).withColumn("section_ord", F.coalesce(F.try_element_at(number, F.col("section_title")), F.lit(99)))
    figures = table(spark, sf, "financial_evidence").select(
        F.concat_ws("|", "run_id", F.lit("Financial Performance")).alias("section"), F.lit(3).alias("section_ord"), F.col("evidence_id").cast("int").alias("fig_ord"),
        "metric_name", "value", "fiscal_year", "source_quote", F.col("page_number").alias("page"), F.col("doc_name").alias("doc"),
    )
    return appendix.build(claims, evidence, figures, compat)


def appendix_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _appendix(spark, sf, False).select("section", "entry_type", "claim_id", "status", "evidence_id", "doc", "page", "quote", "metric", "value")


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    number = F.create_map(*[x for i, t in enumerate(SECTIONS) for x in (F.lit(t), F.lit(i + 1))])
    s = grounding.summary(verified).select(F.split("section", r"\|")[0].alias("run_id"), F.split("section", r"\|")[1].alias("section"), "confidence")
    return s.withColumn("section_ord", F.try_element_at(number, F.col("section")))


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    """Review actions read off the event log: a step's event acts on the section of that number."""
    titles = F.array(*map(F.lit, SECTIONS))
    events = progress.distinct_events(table(spark, sf, "job_events"))
    action = F.when(F.col("status") == "complete", "export").when(F.col("status") == "error", "reverify").otherwise("approve")
    return events.select(F.col("job_id").alias("run_id"), "seq", action.alias("action"), F.when(F.col("step") >= 1, F.try_element_at(titles, F.col("step"))).alias("section"), F.col("message").alias("reason"), F.col("event_ts").alias("ts"))


def review_state(spark: SparkSession, sf: str) -> DataFrame:
    return review.state(_sections(spark, sf), _actions(spark, sf).filter("section IS NOT NULL")).select("run_id", "section", "approved", "override_reason")


def review_gate(spark: SparkSession, sf: str) -> DataFrame:
    folded = review.state(_sections(spark, sf), _actions(spark, sf).filter("section IS NOT NULL"))
    return review.gate(folded)


def export_versions(spark: SparkSession, sf: str) -> DataFrame:
    return review.versions(_sections(spark, sf), _actions(spark, sf)).select("run_id", "seq", "allowed", F.col("version").cast("bigint").alias("version"))


# ---- evaluation --------------------------------------------------------------------------------------------------


def claim_rates(spark: SparkSession, sf: str) -> DataFrame:
    verified, _ = _verified(spark, sf)
    r = quality.claim_rates(verified, ["run_id"])
    return r.select("run_id", F.round("support_rate", 6).alias("support_rate"), F.round("unsupported_rate", 6).alias("unsupported_rate"))


def flag_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _figures(spark, sf)
    predicted = reconcile.flags(reconcile.worst_pairs(rows, 0.01))
    expected = reconcile.flags(reconcile.worst_pairs(rows, 0.2))
    scored = quality.precision_recall(quality.flag_scores(predicted, expected, "run_id"))
    return scored.select("run_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def cost_by_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "doc_chunks")
    events = rows.select(
        F.col("source").alias("name"), F.col("chunk_key").alias("ord"), (F.unix_millis("ingested_at") - F.unix_millis("created_at")).cast("double").alias("latency_ms"),
        F.length("text").alias("chars"), F.lit(None).cast("bigint").alias("tokens_known"),
    )
    return quality.cost_by_name(quality.cost_events(events))


# ---- the whole pipeline ------------------------------------------------------------------------------------------


def memo_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The memos of all runs: each section's verdict, with the number of rows that the other tables of the memo hold for it."""
    out = pipeline.run(table(spark, sf, "doc_chunks"), list(SECTIONS))
    counted = out["sections"].select("section", "section_ord", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_supported")], F.round("confidence", 6).alias("confidence"))
    for name in ("evidence", "citations", "appendix"):
        n = out[name].groupBy("section").agg(F.count("*").alias(f"n_{name}"))
        counted = counted.join(n, "section", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    flags = out["flags"].groupBy("run_id").agg(F.count("*").alias("n_flags"))
    rows = counted.select("section.run_id", F.col("section.title").alias("section_title"), *counted.columns[1:])
    return rows.join(flags, "run_id", "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(0)))


# ---- jobs --------------------------------------------------------------------------------------------------------


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    s = progress.latest(table(spark, sf, "job_events"))
    return s.select("job_id", "n_events", "last_seq", "status", "step", "message", review.job_guard(F.col("status"), F.lit(True)).alias("code"))


def unseen_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events past the middle of each job's log."""
    events = progress.distinct_events(table(spark, sf, "job_events"))
    cursor = events.groupBy("job_id").agg(F.floor(F.avg("seq")).alias("seen"))
    return progress.unseen(events, cursor).select("job_id", "seq", "step", "status", "message")


def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "job_events").filter("status = 'error'")
    return failed.select("event_key", review.error_code(F.col("message")).alias("error_code"), review.retryable(F.col("message")).alias("retryable"))


def progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log replayed as a stream; running counts by job and status."""
    schema = table(spark, sf, "job_events").schema
    stream = progress.status_counts(progress.read_events(spark, f"{sf}/job_events.parquet*", schema))
    name = f"progress_{abs(hash(sf)) % 10**8}"
    return progress.run_available(stream, name, "complete")


QUERIES = {
    f.__name__: f
    for f in (
        nonblank_chunks, evidence_projection, documents_by_run, section_slots, first_chunks, company_texts, document_text, canonical_metrics, canonical_periods, numeric_values,
        formatted_values, reconcile_groups, reconcile_worst, reconcile_flags, reconcile_orders, labelled_figures, chunk_tokens, term_idf, bm25_topk,
        dense_topk, hash_embeddings, hybrid_topk, char_windows, index_chunks, deduped_evidence, claim_evidence, local_verdicts, verification_summary,
        supported_rate_by_run, gap_queries, citations, bracketed_narratives, appendix_rows, review_state, review_gate, export_versions, claim_rates,
        flag_scores, cost_by_name, memo_pipeline, job_states, unseen_events, error_classes, progress_stream,
    )
}
