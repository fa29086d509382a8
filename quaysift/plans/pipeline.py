"""The memo pipeline composed of the operators: chunks -> evidence -> claims -> figures -> flags -> appendix -> gate."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysift.config import DEFAULT, EngineConfig
from quaysift.operators import appendix, chunking, financial, grounding, reconcile, retrieval, scoped
from quaysift.session import cut_lineage


class Generator(Protocol):
    """(section, e_ord, quote) of all sections -> (section, narrative, claims); adapters to models implement it."""

    def __call__(self, evidence: DataFrame) -> DataFrame: ...


def extractive(evidence: DataFrame) -> DataFrame:
    """Offline generator: each piece of evidence gives its first sentence as a claim that cites it."""
    sentence = F.regexp_extract(F.coalesce("quote", F.lit("")), r"(?s)^\s*(.{1,400}?[.!?])(?:\s|$)", 1)
    text = F.when(sentence != "", sentence).otherwise(F.substring(F.coalesce("quote", F.lit("")), 1, 200))
    claim = F.struct(F.concat(F.lit("c"), F.col("e_ord")).alias("claim_id"), text.alias("text"), F.array("eid").alias("citation_ids"), F.lit("insufficient").alias("status"))
    g = evidence.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("e_ord", claim.alias("c"))))["c"].alias("claims"))
    return g.select("section", F.array_join(F.transform("claims", lambda c: c["text"]), " ").alias("narrative"), "claims")


def evidence_of(hits: DataFrame) -> DataFrame:
    """Retrieved chunks (qid, rank, doc_name, page, quote) as evidence: document without its sheet."""
    return hits.select(F.col("qid").alias("section"), "rank", F.element_at(F.split("doc_name", "::"), 1).alias("doc"), F.greatest("page", F.lit(1)).alias("page"), "quote")


def section_key(title: str | Column) -> Column:
    """The key of a run's section."""
    return F.struct("run_id", (F.lit(title) if isinstance(title, str) else title).alias("title"))


def run_sections(chunks: DataFrame, titles: list[str], generator: Generator = extractive, judge: grounding.Judge | None = None, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence) of all sections of all runs after at most max_agent_rounds + 1 rounds; section: (run_id, title).

    A round handles all open sections at once, each among the chunks of its run; the driver learns only whether any is open.
    """
    spark = chunks.sparkSession
    first = spark.createDataFrame([(t, retrieval.expand_query(t)) for t in titles], "title string, query string")
    asked = chunks.select("run_id").distinct().crossJoin(F.broadcast(first)).select("run_id", section_key(F.col("title")).alias("qid"), "query")
    asked = cut_lineage(asked)
    corpora = scoped.Corpora(chunks, config)
    evidence = claims = None
    for round_no in range(config.max_agent_rounds + 1):
        found = evidence_of(corpora.hybrid(asked, config.top_k)).withColumn("round", F.lit(round_no))
        pool = found if evidence is None else evidence.select(*found.columns).unionByName(found)
        evidence = cut_lineage(grounding.dedupe_evidence(pool, ["round", "rank", "doc", "page"]))
        open_evidence = evidence.join(asked.select(F.col("qid").alias("section")), "section", "left_semi")
        drawn = grounding.extract_claims(generator(open_evidence), open_evidence)
        verdicts = judge(drawn, open_evidence) if judge else None
        verified = cut_lineage(grounding.verify(drawn, open_evidence, verdicts))
        repair = grounding.summary(verified, sections=asked.select(F.col("qid").alias("section"))).filter("needs_repair").select("section")
        last = round_no == config.max_agent_rounds
        settled = verified if last else verified.join(repair, "section", "left_anti")
        claims = settled if claims is None else claims.unionByName(settled)
        if last:
            break
        gaps = repair.join(grounding.gap_queries(verified), "section", "left")
        query = F.coalesce(F.substring(F.concat("section.title", F.lit(": "), "gap_query"), 1, 500), F.col("section.title"))
        asked = cut_lineage(gaps.select("section.run_id", F.col("section").alias("qid"), query.alias("query")))
        if asked.isEmpty():
            break
    return claims, evidence


def index_of(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Index chunks with a key of their own each: its order is that of run, document and place, whatever the rows' number.

    The keys are fixed by the checkpoint; equal keys cannot arise even from repeated deliveries of a chunk. The chunks are dealt by range
    before they are split, so that they are split once (a sort of the pieces would split them for its sample too).
    """
    order = ["run_id", "doc_name", "pos", "chunk_id", "sub_pos", "page", "is_table", "text"]
    placed = chunks.repartitionByRange("run_id", "doc_name", "pos")
    keyed = chunking.expand(placed, config, in_place=True).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    return cut_lineage(keyed.select("key", "run_id", "doc_name", "page", "chunk_id", "text", "is_table"))


def run(chunks: DataFrame, titles: list[str], config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """All tables of the memos, one memo for each run, from chunks (run_id, doc_name, page, chunk_id, pos, text, is_table)."""
    chunks = chunks.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    index = index_of(chunks, config)
    claims, evidence = run_sections(index, titles, config=config)
    named = chunks.sparkSession.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, section_ord int")
    order = chunks.select("run_id").distinct().crossJoin(F.broadcast(named)).select(section_key(F.col("title")).alias("section"), "section_ord")
    summary = grounding.summary(claims, config.confidence_threshold)
    sections = order.join(summary, "section", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.3)))
    figures = financial.labelled_figures(chunks, ("run_id",)).withColumn("evidence_id", F.xxhash64("run_id", "doc_name", "page", "source_quote")).withColumn("value_kind", F.lit("str"))
    flags = reconcile.flags(reconcile.worst_pairs(reconcile.normalised(figures), config.relative_tolerance))
    figure_section = next((t for t in titles if any(w in t.lower() for w in ("financial", "metric", "kpi", "figure", "performance", "historical", "accounting"))), titles[0])
    in_memo = figures.select(section_key(figure_section).alias("section"), F.lit(titles.index(figure_section)).alias("section_ord"), F.col("pos").cast("int").alias("fig_ord"), "metric_name", "value", "fiscal_year", "source_quote", F.col("page_number" if "page_number" in figures.columns else "page").alias("page"), F.col("doc_name").alias("doc"))
    book = appendix.build(claims.withColumn("title", F.col("section.title")).join(order, "section"), evidence, in_memo)
    return {"index": index, "claims": claims, "evidence": evidence, "sections": sections, "figures": figures, "flags": flags, "appendix": book, "citations": grounding.citations(claims, evidence)}
