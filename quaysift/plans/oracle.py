"""DuckDB statements that give the same rows as the queries of ``queries``."""

from __future__ import annotations

from quaysift.plans.queries import SECTIONS

# every kind of white space, as the engine's (?U)\s
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN = "[a-z0-9]+(?:''[a-z]+)?"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


# Fixed values, stated here once more so that the statements rest on nothing of the engine: canonical metric -> spellings.
_SPELLINGS = {
    "revenue": "rev revenue revenues sales net_sales netsales total_revenue total_revenues", "ebitda": "ebitda adj_ebitda adjusted_ebitda",
    "net_income": "net_income netincome net_profit profit earnings", "gross_profit": "gross_profit", "gross_margin": "gross_margin",
    "operating_income": "operating_income operating_profit", "arr": "arr", "mrr": "mrr",
}
_ALIASES = "MAP {" + ", ".join(f"'{s.replace('_', ' ')}': '{k}'" for k, v in _SPELLINGS.items() for s in v.split()) + "}"


def metric(c: str) -> str:
    text = strip(f"coalesce({c}, '')")
    key = f"regexp_replace(lower({text}), '[_\\-/]+', ' ', 'g')"
    key = strip(f"regexp_replace(regexp_replace({key}, '{WORD}', '', 'g'), '{WS}+', ' ', 'g')")
    return f"(SELECT CASE WHEN k = '' THEN 'unknown' ELSE coalesce({_ALIASES}[k], CASE WHEN k LIKE 'total %' THEN {_ALIASES}[regexp_replace(k, '^total ', '')] END, replace(k, ' ', '_')) END FROM (SELECT {key} AS k))"


def period(c: str) -> str:
    """The period rules in SQL: s is the text with single blanks in capitals, p the same without blanks, hyphens, underscores and slashes."""
    raw = strip(f"coalesce({c}, '')")
    y = lambda g: f"CASE WHEN length({g}) = 2 THEN CASE WHEN CAST({g} AS INT) < 80 THEN '20' ELSE '19' END || {g} ELSE {g} END"
    ex = lambda p, g: f"regexp_extract(p, '{p}', {g})"
    q1, q2, q3 = "^Q([1-4])(?:FY)?''?(\\d{4}|\\d{2})$", "^([1-4])Q(?:FY)?''?(\\d{4}|\\d{2})$", "^(?:FY)?''?(\\d{4}|\\d{2})Q([1-4])$"
    return (
        "(SELECT CASE WHEN s = '' THEN 'unknown' WHEN s IN ('TTM', 'LTM', 'TRAILING TWELVE MONTHS') THEN 'TTM' "
        "WHEN regexp_matches(s, '^(FY ?''?)?\\d{4}$') THEN 'FY' || right(s, 4) "
        f"WHEN regexp_matches(s, '^FY ?''?\\d{{2}}$') THEN 'FY' || {y('right(s, 2)')} "
        f"WHEN regexp_matches(p, '{q1}') THEN 'Q' || {ex(q1, 1)} || 'FY' || {y(ex(q1, 2))} "
        f"WHEN regexp_matches(p, '{q2}') THEN 'Q' || {ex(q2, 1)} || 'FY' || {y(ex(q2, 2))} "
        f"WHEN regexp_matches(p, '{q3}') THEN 'Q' || {ex(q3, 2)} || 'FY' || {y(ex(q3, 1))} "
        f"ELSE replace(s, ' ', '') END FROM (SELECT s, regexp_replace(s, '[ _/-]+', '', 'g') AS p FROM (SELECT upper(regexp_replace({raw}, '{WS}+', ' ', 'g')) AS s)))"
    )


def numeric(c: str, kind: str) -> str:
    money = r"(?i)\b(?:usd|eur|gbp|cad|aud)\b|[$€£¥]"
    clean = lambda x: strip(f"regexp_replace({x}, '{money}', '', 'g')")
    body = r"^([+-]?)(\d+(?:\.\d+)?|\.\d+)\s*([A-Za-z]*)$"
    unit = f"lower(regexp_extract(b, '{body}', 3))"
    factor = f"CASE {unit} WHEN '' THEN 1e0 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 't' THEN 1e12 END"
    number = f"try_cast(regexp_extract(b, '{body}', 2) AS DOUBLE) * ({factor}) * CASE WHEN regexp_extract(b, '{body}', 1) = '-' THEN -1e0 ELSE 1e0 END"
    plain = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
    return f"""(SELECT CASE WHEN coalesce({kind}, '') <> 'bool' THEN
      (CASE WHEN regexp_matches(b, '{body}') AND ({factor}) IS NOT NULL THEN {number} WHEN regexp_matches(b, '{plain}') THEN try_cast(b AS DOUBLE) END)
      * CASE WHEN wrapped THEN -1e0 ELSE 1e0 END * CASE WHEN s4 LIKE '-%' THEN -1e0 ELSE 1e0 END END
      FROM (SELECT *, {strip("regexp_replace(s4, '^-', '')")} AS b FROM (SELECT *, regexp_replace({strip("regexp_replace(replace(s3, ',', ''), '%$', '')")}, '^[+]', '') AS s4
      FROM (SELECT *, CASE WHEN wrapped THEN {strip("regexp_replace(regexp_replace(s1, '^[(]|[)]$', '', 'g'), '" + money + "', '', 'g')")} ELSE s1 END AS s3
      FROM (SELECT s1, regexp_matches(s1, '^[(].*[)]$') AS wrapped FROM (SELECT {clean(strip(c))} AS s1))))))"""


FIGURES = f"""figures AS MATERIALIZED (SELECT evidence_id, run_id, {metric('metric_name')} AS metric, {period('fiscal_year')} AS period,
  {numeric('value', 'value_kind')} AS num, {strip("coalesce(value, '')")} AS raw, doc_name FROM financial_evidence)"""
DELTA = "CASE WHEN greatest(abs(a.num), abs(b.num)) = 0 THEN 0e0 ELSE abs(a.num - b.num) / greatest(abs(a.num), abs(b.num)) END"


def worst(tolerance: float, name: str = "worst") -> str:
    """All pairs of rows, and of each group's disagreeing pairs the first with the greatest delta."""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT a.run_id, a.metric, a.period, a.evidence_id AS a_id, b.evidence_id AS b_id, a.doc_name AS a_doc, b.doc_name AS b_doc, a.raw AS a_raw, b.raw AS b_raw,
      a.num AS a_num, b.num AS b_num, CASE WHEN a.num IS NOT NULL AND b.num IS NOT NULL THEN {DELTA} END AS delta
      FROM figures a JOIN figures b ON a.run_id = b.run_id AND a.metric = b.metric AND a.period = b.period AND a.evidence_id < b.evidence_id)
      WHERE CASE WHEN a_num IS NOT NULL AND b_num IS NOT NULL THEN delta > {tolerance} ELSE a_raw <> b_raw END
      QUALIFY row_number() OVER (PARTITION BY run_id, metric, period ORDER BY coalesce(delta, 1e0) DESC, a_id, b_id) = 1)"""


def _shown(n: str) -> str:
    return f"""CASE WHEN {n} = 0 THEN '0' WHEN abs({n}) >= 1e9 THEN printf('%.4g', {n} / 1e9) || 'B' WHEN abs({n}) >= 1e6 THEN printf('%.4g', {n} / 1e6) || 'M'
      WHEN abs({n}) >= 1e3 THEN printf('%.4g', {n} / 1e3) || 'K' WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE printf('%.6g', {n}) END"""


def _side(s: str) -> str:
    return f"coalesce({s}_doc, 'unknown') || '=' || {s}_raw || ' ' || CASE WHEN {s}_num IS NULL THEN '(unparseable)' ELSE '(norm=' || {_shown(s + '_num')} || ')' END"


_LABEL = "array_to_string(list_transform(string_split(replace(metric, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
FLAG = f"{_LABEL} || ' discrepancy (' || period || '): ' || {_side('a')} || ' vs ' || {_side('b')} || CASE WHEN delta IS NULL THEN '' ELSE printf(', delta=%.2f%%', delta * 100) END"

# The expanded queries of the six sections, written out by the rules.
_EXPANDED = (
    "Executive Summary overview highlights key findings investment thesis company snapshot transaction",
    "Market Overview TAM SAM SOM size growth rate industry competitive landscape share addressable",
    "Business Model",
    "Financial Performance revenue EBITDA margin ARR growth gross operating income cash flow free FCF net NRR churn LTV CAC burn runway valuation multiples",
    "Management Team CEO CFO founders executives leadership board background experience",
    "Key Risks risk factors challenges headwinds customer concentration regulatory litigation dependency",
)
QUERY_VALUES = ", ".join(f"({i}, {quoted(q)})" for i, q in enumerate(_EXPANDED))
BM25 = f"""quotes AS (SELECT evidence_key, quote FROM evidence_chunks WHERE quote IS NOT NULL),
  toks AS MATERIALIZED (SELECT evidence_key, regexp_extract_all(lower(quote), '{TOKEN}') AS t FROM quotes),
  post AS MATERIALIZED (SELECT evidence_key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT evidence_key, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
  size AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM toks),
  raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), size),
  idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
  queries(qid, query) AS (VALUES {QUERY_VALUES}),
  asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM queries) GROUP BY 1, 2),
  bm25 AS MATERIALIZED (SELECT qid, evidence_key, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM post JOIN asked USING (term) JOIN idf USING (term), size GROUP BY 1, 2),
  sparse AS (SELECT qid, evidence_key, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, evidence_key) - 1 AS rank
    FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM bm25) WHERE score > 0 OR best <= 0 QUALIFY rank < 20)"""
SLOT = """((CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 768 * 256 + CAST(('0x' || substr(md5(term), 9, 8)) AS BIGINT)) % 768 * 256
    + CAST(('0x' || substr(md5(term), 17, 8)) AS BIGINT)) % 768 * 256 + CAST(('0x' || substr(md5(term), 25, 8)) AS BIGINT)"""
SIGN = "CASE WHEN (CAST(('0x' || substr(md5(term), 28, 1)) AS INT) & 1) = 1 THEN 1e0 ELSE -1e0 END"


def embedding(source: str, key: str, text: str, name: str) -> str:
    """Sparse vectors of unit length as (key, slot, w)."""
    return f"""{name}_terms AS (SELECT {key} AS key, unnest(CASE WHEN len(t) > 0 THEN t ELSE [CASE WHEN trim({text}) = '' THEN 'empty' ELSE trim({text}) END] END) AS term
      FROM (SELECT *, regexp_extract_all(lower({text}), '{TOKEN}') AS t FROM {source})),
    {name}_slots AS (SELECT key, ({SLOT}) % 768 AS slot, sum({SIGN}) AS w FROM {name}_terms GROUP BY 1, 2 HAVING sum({SIGN}) <> 0),
    {name}_unit AS (SELECT key, slot, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM {name}_slots),
    {name} AS MATERIALIZED (SELECT * FROM {name}_unit UNION ALL SELECT {key}, 0, 1e0 FROM {source} WHERE {key} NOT IN (SELECT key FROM {name}_unit))"""


HYBRID = f"""{BM25}, {embedding('quotes', 'evidence_key', 'quote', 'dv')}, {embedding('queries', 'qid', 'query', 'qv')},
  sims AS (SELECT q.key AS qid, d.key AS evidence_key, sum(q.w * d.w) AS score FROM qv q JOIN dv d USING (slot) GROUP BY 1, 2),
  every AS (SELECT qid, evidence_key, coalesce(score, 0) AS score FROM queries CROSS JOIN quotes LEFT JOIN sims USING (qid, evidence_key)),
  dense AS (SELECT qid, evidence_key, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, evidence_key) - 1 AS rank FROM every QUALIFY rank < 20),
  fused AS (SELECT qid, evidence_key, sum(1e0 / (60 + rank + 1)) AS score, min({{'source': source, 'rank': rank}}) AS first
    FROM (SELECT qid, evidence_key, rank, 0 AS source FROM dense UNION ALL SELECT qid, evidence_key, rank, 1 FROM sparse) GROUP BY 1, 2)"""

EVIDENCE = """ev AS MATERIALIZED (SELECT run_id || '|' || section_title AS section, run_id, section_title, id AS eid, CAST(substr(id, 2) AS INT) AS e_ord, doc, page, quote
  FROM evidence_chunks WHERE section_title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id || '|' || section_title, id ORDER BY evidence_key) = 1)"""


def words_of(c: str) -> str:
    text = strip("coalesce(" + c + ", '')")
    return f"list_filter(list_distinct(string_split_regex(lower({text}), '{WS}+')), lambda w: w <> '')"


CLAIMS = f"""{EVIDENCE}, claims AS MATERIALIZED (SELECT section, run_id, section_title, e_ord AS claim_ord, 'c' || e_ord AS claim_id, coalesce(quote, '') AS text,
    CASE WHEN lead(eid) OVER w IS NULL THEN CAST([] AS VARCHAR[]) ELSE [lead(eid) OVER w] END AS citation_ids FROM ev WINDOW w AS (PARTITION BY section ORDER BY e_ord)),
  cited AS (SELECT section, claim_ord, claim_id, text, unnest(citation_ids) AS eid FROM claims),
  hits AS (SELECT c.section, c.claim_ord, max(len(list_intersect({words_of('c.text')}, {words_of('e.quote')}))) AS overlap FROM cited c JOIN ev e ON c.section = e.section AND c.eid = e.eid GROUP BY 1, 2),
  verified AS MATERIALIZED (SELECT c.*, CASE WHEN overlap IS NULL THEN 'insufficient' WHEN overlap >= greatest(3, len({words_of('text')}) // 4) THEN 'supported' ELSE 'unsupported' END AS status
    FROM claims c LEFT JOIN hits USING (section, claim_ord))"""
SUMMARY = f"""{CLAIMS}, summary AS (SELECT section, count(*) AS total, count_if(status = 'supported') AS n_supported, count_if(status = 'unsupported') AS n_unsupported,
    count_if(status = 'contradicted') AS n_contradicted, count_if(status = 'insufficient') AS n_insufficient, bool_or(status <> 'supported' OR len(citation_ids) = 0) AS needs_repair FROM verified GROUP BY 1),
  scored AS (SELECT *, n_supported / greatest(total, 1) AS rate, CASE WHEN n_supported < total THEN least(n_supported / greatest(total, 1), 0.69e0) ELSE n_supported / greatest(total, 1) END AS confidence FROM summary)"""
ORDS = "MAP {" + ", ".join(f"'{t}': {i}" for i, t in enumerate(SECTIONS)) + "}"
TITLES = "[" + ", ".join(f"'{t}'" for t in SECTIONS) + "]"
EVENTS = "evs AS (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id, seq ORDER BY received_at, event_key) = 1)"
REVIEW = f"""{SUMMARY}, {EVENTS},
  secs AS (SELECT string_split(section, '|')[1] AS run_id, string_split(section, '|')[2] AS section, confidence FROM scored),
  actions AS (SELECT job_id AS run_id, seq, CASE WHEN status = 'complete' THEN 'export' WHEN status = 'error' THEN 'reverify' ELSE 'approve' END AS action,
    CASE WHEN step >= 1 THEN {TITLES}[step] END AS section, message AS reason FROM evs),
  last AS (SELECT run_id, section, max_by(action, seq) AS action, arg_max_null(reason, seq) AS reason FROM actions WHERE section IS NOT NULL AND action <> 'export' GROUP BY 1, 2),
  folded AS (SELECT run_id, section, confidence, coalesce(action = 'approve', false) AS approved,
    CASE WHEN coalesce(action = 'approve', false) AND trim(reason) <> '' THEN trim(reason) END AS override_reason FROM secs LEFT JOIN last USING (run_id, section)),
  gate AS (SELECT run_id, count_if(confidence < 0.7 AND NOT approved AND override_reason IS NULL) AS n_pending FROM folded GROUP BY 1)"""
LINE_FIG = r"(?m)^\s*([A-Z][A-Za-z ]{1,40}?)(?: exiting)? ((?:FY ?\d{2,4}|Q[1-4] ?\d{4}|the trailing twelve months|TTM|LTM))(?: \(restated\))?: ([$€£]\d[\d,]*(?:\.\d+)?(?: million| billion|K|M|m|bn)?|\d+(?:\.\d+)?(?:%| percent))\s*$"
SENT_FIG = r"([A-Z][A-Za-z ]{1,40}?) for ((?:FY ?\d{2,4}|Q[1-4] ?\d{4}|the trailing twelve months|TTM|LTM)) came to ([$€£]\d[\d,]*(?:\.\d+)?(?: million| billion|K|M|m|bn)?|\d+(?:\.\d+)?(?:%| percent))"

SQL = {
    "nonblank_chunks": r"SELECT chunk_key, doc_name, page, pos FROM doc_chunks WHERE regexp_matches(text, '\S')",
    "evidence_projection": r"SELECT chunk_key, string_split(doc_name, '::')[1] AS doc, greatest(page, 1) AS page, substring(text, 1, 1500) AS quote FROM doc_chunks WHERE regexp_matches(text, '\S')",
    "documents_by_run": "SELECT run_id, count(DISTINCT doc_name) AS n_documents, count(*) AS n_chunks FROM doc_chunks GROUP BY 1",
    "section_slots": """WITH s AS (SELECT run_id, section_title AS title, min(evidence_key) AS ord FROM evidence_chunks WHERE section_title IS NOT NULL GROUP BY 1, 2),
      own AS (SELECT run_id, trim(regexp_replace(upper(trim(title)), '[^A-Za-z0-9_]+', '_', 'g'), '_') AS slot, arg_max(title, ord) AS title FROM s GROUP BY 1, 2),
      words(word, slot) AS (VALUES ('market', 'MARKET_OVERVIEW'), ('business', 'BUSINESS_OVERVIEW'), ('financial', 'KEY_FINANCIAL_METRICS'), ('management', 'MANAGEMENT_TEAM'), ('risk', 'RISKS')),
      worded AS (SELECT run_id, slot, arg_min(title, ord) AS title FROM s JOIN words ON contains(lower(title), word) GROUP BY 1, 2)
      SELECT run_id, slot, title FROM own UNION ALL SELECT * FROM worded WHERE (run_id, slot) NOT IN (SELECT (run_id, slot) FROM own)""",
    "first_chunks": "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos, chunk_key) - 1 AS rank, chunk_key FROM doc_chunks WHERE text IS NOT NULL QUALIFY rank < 8",
    "company_texts": """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos, chunk_key) - 1 AS rank, chunk_key, least(length(text), 3000) AS n_chars, md5(substring(text, 1, 3000)) AS text_md5
      FROM doc_chunks WHERE length(text) > 300 QUALIFY rank < 2""",
    "document_text": """SELECT run_id, doc_name, length(t) AS n_chars, md5(t) AS text_md5 FROM
      (SELECT run_id, doc_name, string_agg(text, chr(10) || chr(10) ORDER BY pos, chunk_key) AS t FROM doc_chunks WHERE text IS NOT NULL GROUP BY 1, 2)""",
    "canonical_metrics": f"SELECT metric_name, {metric('metric_name')} AS metric FROM (SELECT metric_name FROM financial_evidence UNION SELECT metric FROM financials)",
    "canonical_periods": f"SELECT fiscal_year, {period('fiscal_year')} AS period FROM (SELECT fiscal_year FROM financial_evidence UNION SELECT fiscal_year FROM financials)",
    "numeric_values": f"SELECT evidence_id, CASE WHEN abs(num) < 1e9 THEN round(num, 6) ELSE num END AS num FROM (SELECT evidence_id, {numeric('value', 'value_kind')} AS num FROM financial_evidence)",
    "formatted_values": f"WITH {FIGURES} SELECT evidence_id, {_shown('num')} AS shown FROM figures WHERE num IS NOT NULL",
    "reconcile_groups": f"WITH {FIGURES}, {worst(0.01)} SELECT run_id, metric, period, count(*) AS n FROM figures JOIN (SELECT run_id, metric, period FROM worst) USING (run_id, metric, period) GROUP BY 1, 2, 3",
    "reconcile_worst": f"WITH {FIGURES}, {worst(0.01)} SELECT run_id, metric, period, a_id, b_id, round(delta, 9) AS delta FROM worst",
    "reconcile_flags": f"WITH {FIGURES}, {worst(0.01)} SELECT run_id, metric, period, {FLAG} AS flag FROM worst",
    "reconcile_orders": """WITH o AS (SELECT o_orderkey, 'FY' || year(o_orderdate) AS period, o_totalprice FROM orders),
      a AS (SELECT period, sum(o_totalprice) AS x FROM o GROUP BY 1),
      b AS (SELECT period, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS y FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1)
      SELECT 'revenue' AS metric, period, round(x, 2) AS orders_num, round(y, 2) AS lines_num, round(abs(x - y) / greatest(abs(x), abs(y)), 6) AS delta
      FROM a JOIN b USING (period) WHERE abs(x - y) / greatest(abs(x), abs(y)) > 0.01""",
    "labelled_figures": f"""WITH found AS (SELECT unnest(regexp_extract_all(text, '{LINE_FIG}')) AS q, 0 AS k FROM doc_chunks UNION ALL SELECT unnest(regexp_extract_all(text, '{SENT_FIG}')), 1 FROM doc_chunks),
      parts AS (SELECT CASE WHEN k = 0 THEN trim(regexp_extract(q, '{LINE_FIG}', 1)) ELSE trim(regexp_extract(q, '{SENT_FIG}', 1)) END AS metric_name,
        CASE WHEN k = 0 THEN trim(regexp_extract(q, '{LINE_FIG}', 3)) ELSE trim(regexp_extract(q, '{SENT_FIG}', 3)) END AS value FROM found)
      SELECT metric_name, count(*) AS n, min(value) AS least, max(value) AS greatest FROM parts GROUP BY 1""",
    "chunk_tokens": f"SELECT chunk_key, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT chunk_key, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM doc_chunks WHERE text IS NOT NULL)",
    "term_idf": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {BM25} SELECT qid, evidence_key, round(score, 6) AS score, rank FROM sparse",
    "dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT q.vec_id AS qid, d.vec_id, list_cosine_similarity(q.e, d.e) AS score FROM v d, v q WHERE q.vec_id % 100 = 0)
      SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank FROM s QUALIFY rank < 5""",
    "hash_embeddings": f"""WITH quotes AS (SELECT evidence_key, quote FROM evidence_chunks WHERE quote IS NOT NULL), {embedding('quotes', 'evidence_key', 'quote', 'dv')}
      SELECT key AS evidence_key, CAST(count(*) AS INT) AS n_slots, round(sum(w * (slot + 1)), 6) AS moment FROM dv GROUP BY 1""",
    "hybrid_topk": f"WITH {HYBRID} SELECT qid, evidence_key, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, evidence_key) - 1 AS rank FROM fused QUALIFY rank < 5",
    "char_windows": r"""WITH w AS (SELECT doc_id, list_filter(list_transform(range(0, CAST(greatest(ceil((length(text) - 800) / 680.0), 0) AS BIGINT) + 1), lambda i: substring(text, i * 680 + 1, 800)), lambda x: regexp_matches(x, '\S')) AS w FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, len(w) AS n_windows, length(w[-1]) AS last_size, md5(array_to_string(w, '|')) AS windows_md5 FROM w""",
    "deduped_evidence": """WITH r AS (SELECT run_id || '|' || section_title AS section, evidence_key, doc, page, substring(coalesce(quote, ''), 1, 100) AS head FROM evidence_chunks WHERE section_title IS NOT NULL),
      f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY section, doc, page, head ORDER BY evidence_key) = 1)
      SELECT section, 'e' || row_number() OVER (PARTITION BY section ORDER BY evidence_key) AS eid, evidence_key, doc, page FROM f""",
    "claim_evidence": f"WITH {CLAIMS} SELECT c.section, c.claim_id, c.eid, e.doc, e.page FROM cited c JOIN ev e ON c.section = e.section AND c.eid = e.eid",
    "local_verdicts": f"WITH {CLAIMS} SELECT section, claim_id, status FROM verified",
    "verification_summary": f"WITH {SUMMARY} SELECT section, total, n_supported, n_unsupported, n_contradicted, n_insufficient, round(rate, 6) AS rate, round(confidence, 6) AS confidence, needs_repair FROM scored",
    "supported_rate_by_run": f"WITH {CLAIMS} SELECT run_id, count_if(status = 'supported') AS n_supported, count(*) AS total, round(count_if(status = 'supported') / greatest(count(*), 1), 6) AS rate FROM verified GROUP BY 1",
    "gap_queries": f"""WITH {CLAIMS} SELECT section, substring(array_to_string(list(text ORDER BY claim_ord)[1:5], ' '), 1, 500) AS gap_query FROM verified
      WHERE status <> 'supported' OR len(citation_ids) = 0 GROUP BY 1""",
    "citations": f"""WITH {CLAIMS}, used AS (SELECT DISTINCT section, eid FROM cited), hit AS (SELECT DISTINCT section, doc, page FROM ev SEMI JOIN used USING (section, eid))
      SELECT * FROM hit UNION ALL SELECT DISTINCT section, doc, page FROM ev ANTI JOIN hit USING (section)""",
    "appendix_rows": f"""WITH {CLAIMS},
      c AS (SELECT section, section_title, claim_ord, claim_id, status, CASE WHEN len(citation_ids) > 0 THEN citation_ids[1] END AS eid FROM verified),
      rows AS (SELECT c.section, 'claim' AS entry_type, claim_ord AS o1, claim_id, status, c.eid AS evidence_id, CASE WHEN c.eid IS NULL THEN '(uncited)' ELSE doc END AS doc, CASE WHEN c.eid IS NULL THEN 1 ELSE page END AS page,
          CASE WHEN c.eid IS NULL THEN '' WHEN length(quote) > 200 THEN substring(quote, 1, 200) || '...' ELSE quote END AS quote, c.section_title || ' · ' || claim_id || ' [' || status || ']' AS metric, CAST(NULL AS VARCHAR) AS value, claim_id || chr(1) || coalesce(c.eid, '') AS key
        FROM c LEFT JOIN ev e ON c.section = e.section AND c.eid = e.eid WHERE c.eid IS NULL OR doc IS NOT NULL
        UNION ALL SELECT run_id || '|Financial Performance', 'fin', evidence_id, NULL, NULL, NULL, doc_name, page_number, CASE WHEN length(source_quote) > 200 THEN substring(source_quote, 1, 200) || '...' ELSE source_quote END,
          metric_name, value, coalesce(doc_name, '') || chr(1) || coalesce(CAST(page_number AS VARCHAR), '') || chr(1) || coalesce(metric_name, '') FROM financial_evidence)
      SELECT section, entry_type, claim_id, status, evidence_id, doc, page, quote, metric, value FROM rows QUALIFY row_number() OVER (PARTITION BY section, entry_type, key ORDER BY o1) = 1""",
    "review_state": f"WITH {REVIEW} SELECT run_id, section, approved, override_reason FROM folded",
    "review_gate": f"WITH {REVIEW} SELECT run_id, n_pending, n_pending = 0 AS export_allowed FROM gate",
    "export_versions": f"""WITH {REVIEW}, low AS (SELECT run_id, section FROM secs WHERE confidence < 0.7), ex AS (SELECT run_id, seq FROM actions WHERE action = 'export'),
      acts AS (SELECT ex.run_id, ex.seq, low.section, max_by(a.action, a.seq) AS action FROM ex JOIN low ON ex.run_id = low.run_id LEFT JOIN actions a ON a.run_id = ex.run_id AND a.section = low.section AND a.seq < ex.seq AND a.action <> 'export' GROUP BY 1, 2, 3),
      ok AS (SELECT ex.run_id, ex.seq, coalesce(bool_and(coalesce(acts.action = 'approve', false)) FILTER (acts.section IS NOT NULL), true) AS allowed FROM ex LEFT JOIN acts USING (run_id, seq) GROUP BY 1, 2)
      SELECT run_id, seq, allowed, CASE WHEN allowed THEN CAST(count_if(allowed) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) END AS version FROM ok""",
    "claim_rates": f"""WITH {CLAIMS} SELECT run_id, round(avg(CASE WHEN status = 'supported' THEN 1e0 ELSE 0e0 END), 6) AS support_rate,
      round(avg(CASE WHEN status IN ('unsupported', 'contradicted') THEN 1e0 ELSE 0e0 END), 6) AS unsupported_rate FROM verified GROUP BY 1""",
    "flag_scores": f"""WITH {FIGURES}, {worst(0.01, 'p')}, {worst(0.2, 'e')},
      b AS (SELECT coalesce(p.run_id, e.run_id) AS run_id, p.metric IS NOT NULL AS inp, e.metric IS NOT NULL AS ine FROM p FULL JOIN e ON p.run_id = e.run_id AND p.metric = e.metric AND p.period = e.period),
      s AS (SELECT run_id, count_if(inp AND ine) AS tp, count_if(inp AND NOT ine) AS fp, count_if(ine AND NOT inp) AS fn FROM b GROUP BY 1),
      r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1e0 ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1e0 ELSE 0e0 END AS recall FROM s)
      SELECT run_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END, 6) AS f1 FROM r""",
    "cost_by_name": """WITH e AS (SELECT source AS name, chunk_key AS ord, CAST(epoch_ms(ingested_at) - epoch_ms(created_at) AS DOUBLE) AS latency_ms, greatest(coalesce(length(text), 0), 0) // 4 AS tokens FROM doc_chunks)
      SELECT name, count(*) AS calls, arg_max_null(latency_ms, ord) AS latency_ms, arg_max_null(tokens, ord) AS tokens, round(arg_max_null(tokens, ord) / 1000.0 * 0.00015, 8) AS cost FROM e GROUP BY 1""",
    "job_states": """SELECT job_id, count(*) AS n_events, max(seq) AS last_seq, arg_max_null(status, {'s': seq, 'r': received_at, 'k': event_key}) AS status, arg_max_null(step, {'s': seq, 'r': received_at, 'k': event_key}) AS step,
      arg_max_null(message, {'s': seq, 'r': received_at, 'k': event_key}) AS message,
      CASE arg_max_null(status, {'s': seq, 'r': received_at, 'k': event_key}) WHEN 'pending' THEN 202 WHEN 'running' THEN 202 WHEN 'error' THEN 500 ELSE 200 END AS code FROM job_events GROUP BY 1""",
    "unseen_events": f"""WITH {EVENTS} SELECT job_id, seq, step, status, message FROM evs JOIN (SELECT job_id, floor(avg(seq)) AS seen FROM evs GROUP BY 1) USING (job_id) WHERE seq > seen""",
    "error_classes": """SELECT event_key, CASE WHEN contains(m, 'gemini_api_key') OR contains(m, 'api key') THEN 'missing_api_key' WHEN contains(m, '429') OR contains(m, 'resource_exhausted') OR (contains(m, 'rate') AND contains(m, 'limit')) THEN 'rate_limited'
      WHEN contains(m, 'embedding') THEN 'embedding_error' WHEN contains(m, 'timeout') THEN 'timeout' ELSE 'pipeline_error' END AS error_code,
      regexp_matches(m, '429|resource_exhausted|503|unavailable|timeout|500|internal|11001|getaddrinfo|connection|network') OR (contains(m, 'rate') AND contains(m, 'limit')) AS retryable FROM (SELECT event_key, lower(coalesce(message, '')) AS m FROM job_events WHERE status = 'error')""",
    "progress_stream": "SELECT job_id, status, count(*) AS n_events, max(seq) AS last_seq FROM job_events GROUP BY 1, 2",
}
