"""Registered queries over the review operators, each with its SQL.

The driver's tables stand in for sessions: three documents that follow one another by doc_id are a session,
in upload order; ``labels`` are the analyzers' answers, ``events`` the progress logs of a user's session, ``conversations``
the chat. Texts are compared by their md5.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.strict_json import flat_content
from lectern.operators import analysis, assemble, brands, chat, model, progress, review, search, session_states, verdict
from lectern.operators.analysis import ANALYZERS, RECORDS, SEVERITIES
from lectern.sources import intake, pdf, pdf_writer
from lectern.sources.shared import durable, scratch, shared_folder
from lectern.sources.state_store import StateStore
from lectern.streaming import events, frames, log_store, log_tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FENCE = T.FENCE
#: Seconds of silence that recorded rows may have between micro-batches: the clock there is the job's.
RECORDED = 7 * 86_400


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search, brands and merges of partial results ---------------------------------------------------

_ITEM = """'Item ' || coalesce(CAST(l_linenumber AS STRING), '') || ': ' || coalesce(p_name, '') || ' (' || coalesce(p_brand, '') || ')'
  || CASE l_returnflag WHEN 'R' THEN ' or equivalent' WHEN 'A' THEN ', or an approved equal' ELSE '' END"""
#: Lines without a number come last, as in the SQL.
_NUMBER = f"coalesce(CAST(l_linenumber AS BIGINT), {1 << 31})"
_PLACED = "SELECT l_orderkey, p_name, p_brand, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS clause_no FROM lineitem JOIN part ON p_partkey = l_partkey"


def _tenders(spark, sf_dir) -> DataFrame:
    """(order, text): an order's lines as the items of a tender, one clause a line; a line without a number or name keeps its clause."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey"))
    items = F.sort_array(F.collect_list(F.struct(F.expr(_NUMBER), "l_partkey", F.expr(_ITEM).alias("item"))))
    return lines.groupBy("l_orderkey").agg(F.concat_ws(". ", items["item"]).alias("text"))


@_query(f"""SELECT l_orderkey, clause_no::INT AS clause_no, brand, count(*) AS n, bool_or(l_returnflag IN ('R', 'A')) AS equivalent
FROM (SELECT *, unnest([lower(p_name), lower(p_brand)]) AS brand FROM ({_PLACED})) GROUP BY l_orderkey, clause_no, brand""")
def brand_mentions(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    names = parts.select(F.col("p_brand").alias("name")).unionByName(parts.select(F.col("p_name").alias("name")))
    return brands.brand_mentions(_tenders(spark, sf_dir), names, "l_orderkey", "text", "name")


@_query(f"""SELECT l_orderkey, count(DISTINCT brand) AS n_brands, count(DISTINCT CASE WHEN l_returnflag NOT IN ('R', 'A') THEN brand END) AS n_restrictive,
  CASE WHEN bool_or(l_returnflag NOT IN ('R', 'A')) THEN 'high' ELSE 'low' END AS severity
FROM (SELECT *, unnest([lower(p_name), lower(p_brand)]) AS brand FROM ({_PLACED})) GROUP BY l_orderkey""")
def brand_restrictions(spark, sf_dir):
    return brands.restrictive(brand_mentions(spark, sf_dir), "l_orderkey")


@_query(r"""WITH p AS (
  SELECT page_id, list_filter(regexp_split_to_array(lower(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM pages
), f AS (
  SELECT count(*) AS n, CAST(sum(len(terms)) AS DOUBLE) / count(*) AS mean FROM p
), t AS (
  SELECT page_id, len, term, count(*) AS tf FROM (SELECT page_id, len(terms) AS len, unnest(terms) AS term FROM p) GROUP BY ALL
), d AS (
  SELECT term, count(*) AS df FROM t GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text[1:200]), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark
), s AS (
  SELECT item_id, page_id, CAST(sum(CAST(floor(1000000 * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))) AS BIGINT)) AS BIGINT) AS score
  FROM q JOIN d ON d.term = q.term JOIN t ON t.term = q.term, f GROUP BY ALL
)
SELECT item_id, page_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page_id) AS INT) AS rank FROM s QUALIFY rank <= 3""")
def market_search(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", search.page_text(F.col("html")).alias("text"))
    asked = _table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 200).alias("words"))
    return search.top_pages(pages, asked, "page_id", "text", "item_id", "words")


_PARTIAL = """concat('{"', event_type, '": ', CASE WHEN k % 10 = 0 THEN cast(k as string) WHEN k % 10 = 1 THEN '{}'
  ELSE concat('{"f', k % 4, '": "', event_id, '", "last": ', CASE WHEN k % 3 = 0 THEN 'null' ELSE cast(k as string) END, '}') END, '}')"""


@_query("""WITH e AS (
  SELECT user_id, event_id, event_type AS section, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), c AS (
  SELECT user_id, section, max(event_id) FILTER (k % 10 = 0) AS cut, arg_max(k, event_id) FILTER (k % 10 = 0) AS plain, max(event_id) FILTER (k % 10 <> 0) AS last FROM e GROUP BY ALL
), i AS (
  SELECT user_id, section, field, max(event_id) AS at, arg_max(value, event_id) AS value FROM (
    SELECT user_id, event_id, section, 'f' || k % 4 AS field, '"' || event_id || '"' AS value FROM e WHERE k % 10 > 1
    UNION ALL SELECT user_id, event_id, section, 'last', CASE WHEN k % 3 = 0 THEN 'null' ELSE CAST(k AS VARCHAR) END FROM e WHERE k % 10 > 1) GROUP BY ALL
), o AS (
  SELECT c.user_id, c.section, i.field, i.value FROM c LEFT JOIN i ON i.user_id = c.user_id AND i.section = c.section AND (cut IS NULL OR i.at > cut) WHERE last IS NOT NULL AND (cut IS NULL OR last > cut)
)
SELECT user_id, section, field, CASE WHEN field IS NULL THEN '{}' ELSE value END AS value FROM o
UNION ALL SELECT user_id, section, NULL, CAST(plain AS VARCHAR) FROM c WHERE cut IS NOT NULL AND (last IS NULL OR last < cut)""")
def folded_updates(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return analysis.fold_updates(rows.withColumn("update", F.expr(_PARTIAL)), "user_id", "event_id", "update")


# --- intake and text ---------------------------------------------------------------------------

_SESSIONS = "uploads AS (SELECT *, doc_id // 3 AS session, doc_id % 3 + 1 AS ord FROM documents)"


def _uploads(spark, sf_dir) -> DataFrame:
    """Every document with its session and place in it; a session has three documents at most."""
    return _table(spark, sf_dir, "documents").withColumns({"session": F.expr("doc_id div 3"), "ord": F.expr("doc_id % 3 + 1")})


@_query(f"""WITH {_SESSIONS}, c AS (
  SELECT session, count(*) AS n_docs, string_agg('===== Document ' || ord || ': doc_' || doc_id || '.pdf =====' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY ord) AS t
  FROM uploads GROUP BY session) SELECT session, n_docs, length(t) AS n_chars, md5(t) AS text_md5 FROM c""")
def session_concat(spark, sf_dir):
    files = _uploads(spark, sf_dir).withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return assemble.assemble(files, "session", "name", "text").select("session", "n_docs", F.length("parsed_text").alias("n_chars"), F.md5("parsed_text").alias("text_md5"))


_PARSE = "CASE doc_id % 7 WHEN 0 THEN 'no such file' END"


@_query(f"""SELECT doc_id, md5(CASE WHEN e IS NOT NULL THEN 'Error parsing PDF: ' || e ELSE '--- Page 1 ---' || chr(10) || lang || chr(10) || chr(10) || '--- Page 2 ---' || chr(10) || coalesce(text, '') END) AS text_md5
FROM (SELECT *, {_PARSE} AS e FROM documents)""")
def parsed_pages(spark, sf_dir):
    pages = assemble.paged(F.array(F.col("lang"), F.coalesce("text", F.lit(""))))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(assemble.parsed_or_error(pages, F.expr(_PARSE))).alias("text_md5"))


_PDF_LINES = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F-\\x9F]', ' '{}), '(?s).{{1,80}}'{})"


@_query(f"""WITH l AS (
  SELECT doc_id, {_PDF_LINES.replace(chr(92) * 2, chr(92)).format(", 'g'", "")} AS lines FROM documents
) SELECT doc_id, p AS page_no, md5(array_to_string(lines[(p - 1) * 50 + 1:p * 50], chr(10))) AS text_md5, NULL::VARCHAR AS error
FROM (SELECT doc_id, lines, CAST(unnest(range(1, (len(lines) + 49) // 50 + 1)) AS INT) AS p FROM l)""")
def pdf_pages(spark, sf_dir):
    """Documents written as PDF files, 50 lines a page, and read page by page."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PDF_LINES.format("", ", 0")).alias("lines"))
    paged = F.expr("CASE WHEN size(lines) > 0 THEN transform(sequence(0, (size(lines) - 1) div 50), p -> slice(lines, cast(p * 50 + 1 as int), 50)) END")
    files = pdf_writer.write_pdfs(lines.select("doc_id", paged.alias("pages")), "doc_id", "pages")
    return pdf.read_pages(files, "doc_id").select("doc_id", "page_no", F.md5("text").alias("text_md5"), "error")


_KIND = "CASE lang WHEN 'en' THEN 'application/pdf; v=1' WHEN 'fr' THEN '' WHEN 'de' THEN NULL ELSE 'text/plain' END"


@_query(f"""SELECT batch_id, count(*) AS n_files, count(*) <= 3 AND bool_and(kind IS NULL OR kind = '' OR kind LIKE 'application/pdf%') AND bool_and(lower(name) LIKE '%.pdf') AS accepted
FROM (SELECT doc_id // 3 AS batch_id, {_KIND} AS kind, 'd' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.PDF' WHEN doc_id % 17 = 0 THEN '.txt' ELSE '.pdf' END AS name FROM documents) GROUP BY batch_id""")
def intake_gate(spark, sf_dir):
    name = "concat('d', doc_id, CASE WHEN doc_id % 11 = 0 THEN '.PDF' WHEN doc_id % 17 = 0 THEN '.txt' ELSE '.pdf' END)"
    uploads = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("batch_id"), F.expr(_KIND).alias("kind"), F.expr(name).alias("name"))
    return intake.intake_gate(uploads, "batch_id", "name", "kind")


_UPLOADED = "CASE WHEN lang = 'en' THEN '%PDF-1.7 ' || text WHEN lang = 'fr' THEN '%PD' || text ELSE text END"


@_query(f"SELECT doc_id, strlen(x) BETWEEN 100 AND 52428800 AND starts_with(x, '%PDF') AS valid FROM (SELECT doc_id, {_UPLOADED} AS x FROM documents)")
def uploaded_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", intake.valid_bytes(F.encode(F.expr(_UPLOADED), "UTF-8")).alias("valid"))


@_query("SELECT doc_id, md5(text[1:3000]) AS prefix_md5, length(text[1:3000]) AS n FROM documents")
def doc_prefix_3000(spark, sf_dir):
    short = T.prefix(F.col("text"), 3000)
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(short).alias("prefix_md5"), F.length(short).alias("n"))


@_query("""SELECT doc_id, CASE WHEN lang = 'es' THEN 404 WHEN coalesce(text, '') = '' THEN 400 END AS error_code, md5(text[1:150000]) AS context_md5 FROM documents""")
def chat_context_prefix(spark, sf_dir):
    code = chat.chat_precondition(F.lit(True), F.col("lang") != "es", F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", code.alias("error_code"), F.md5(T.prefix(F.col("text"), 150_000)).alias("context_md5"))


_WRAP = f"""CASE doc_id % 6 WHEN 0 THEN 'pre {FENCE}json' || chr(10) || text || chr(10) || '{FENCE} post' WHEN 1 THEN '{FENCE}' || chr(10) || text || '{FENCE}'
  WHEN 2 THEN '{FENCE}python' || chr(10) || text || '{FENCE}' WHEN 3 THEN '{FENCE}json' || text WHEN 4 THEN text ELSE 'A {FENCE}json' || text || '{FENCE} B {FENCE}jsony{FENCE}' END"""
_STRIP = r"'^[\s\x0B]+|[\s\x0B]+$', '', 'g'"
_FENCED = rf"""CASE WHEN contains(x, '{FENCE}json') THEN regexp_replace(split_part(split_part(x, '{FENCE}json', 2), '{FENCE}', 1), {_STRIP})
  WHEN contains(x, '{FENCE}') THEN regexp_replace(split_part(x, '{FENCE}', 2), {_STRIP}) ELSE x END"""


@_query(f"SELECT doc_id, md5({_FENCED}) AS body_md5, length({_FENCED}) AS n FROM (SELECT doc_id, {_WRAP} AS x FROM documents)")
def fenced_extract(spark, sf_dir):
    wrapped = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_WRAP).alias("x"))
    return wrapped.select("doc_id", T.fenced_body(F.col("x")).alias("body")).select("doc_id", F.md5("body").alias("body_md5"), F.length("body").alias("n"))


_BRACED = "CASE doc_id % 4 WHEN 0 THEN 'Sure: {\"n\": {\"c\": ' || n_chars || '}} ok' WHEN 1 THEN '{\"n\": ' || n_chars WHEN 2 THEN n_chars || '} end' ELSE 'no json ' || n_chars END"


@_query(rf"""SELECT doc_id, CASE WHEN contains(o, '}}') THEN regexp_extract(o, '^(?s)(.*\}})', 1) ELSE o END AS body
FROM (SELECT doc_id, CASE WHEN contains(x, '{{') THEN x[strpos(x, '{{'):] ELSE x END AS o FROM (SELECT doc_id, {_BRACED} AS x FROM documents))""")
def brace_trim(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_BRACED).alias("x")).select("doc_id", T.brace_trim(F.col("x")).alias("body"))


# --- analyses and verdicts -----------------------------------------------------------------------

_SEVERITY = "CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END"
_LIST = ", ".join(f"('{a}', {k}, '{v['severity'][1]}', '{v['severity'][2]}')" for k, (a, v) in enumerate(RECORDS.items()))


def _responses(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(session, doc_id, analyzer, response, error): a fenced answer for labelled documents, words for others, an error for some."""
    joined = docs.join(labels, "doc_id", "left")
    each = joined.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("analyzer"), F.lit(k).alias("k")) for k, a in enumerate(ANALYZERS)])).alias("a"))
    answer = F.concat(F.lit(f'{FENCE}json\n{{"severity": "'), F.expr(_SEVERITY), F.lit('", "compliant": '), F.when(F.expr(_SEVERITY) == "low", "true").otherwise("false"), F.lit(f"}}\n{FENCE}"))
    return each.select(
        "session", "doc_id", "a.analyzer",
        F.when(F.col("quality").isNull(), F.concat(F.lit("I could not read document "), F.col("doc_id").cast("string"))).otherwise(answer).alias("response"),
        F.when((F.col("doc_id") + F.col("a.k")) % 13 == 0, "timeout").alias("error"),
    )


def _recovered_sql(docs: str) -> str:
    return f"""recovered AS (
  SELECT session, d.doc_id, a.name AS analyzer, quality IS NOT NULL AND (d.doc_id + k) % 13 <> 0 AS parsed,
    CASE WHEN (d.doc_id + k) % 13 = 0 THEN error WHEN quality IS NULL THEN bad ELSE {_SEVERITY} END AS severity,
    CASE WHEN quality IS NULL OR (d.doc_id + k) % 13 = 0 THEN a.name = 'market_scope' ELSE {_SEVERITY} = 'low' END AS compliant, k
  FROM {docs} d LEFT JOIN labels l ON d.doc_id = l.doc_id, (VALUES {_LIST}) a(name, k, bad, error))"""


@_query(f"WITH {_SESSIONS}, {_recovered_sql('uploads')} SELECT doc_id, analyzer, parsed, severity, compliant FROM recovered")
def json_recover(spark, sf_dir):
    docs = _uploads(spark, sf_dir).select("session", "doc_id")
    return analysis.recover(_responses(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "analyzer", "parsed", "severity", "compliant")


def _fallback_sql(at: int, error: str) -> str:
    """CASE of the analyzers' records, as JSON, with the error's text put in."""
    whole = {a: json.dumps({k: v[at] for k, v in fields.items()}, separators=(",", ":")).replace("'", "''").replace("{}", f"' || {error} || '") for a, fields in RECORDS.items()}
    return "CASE analyzer " + " ".join(f"WHEN '{a}' THEN '{x}'" for a, x in whole.items()) + " END"


@_query(f"""WITH {_SESSIONS}, {_recovered_sql('uploads')} SELECT doc_id, analyzer, CASE WHEN parsed THEN '{{"severity":"' || severity || '","compliant":' || compliant || '}}'
  WHEN (doc_id + k) % 13 = 0 THEN {_fallback_sql(2, "'timeout'")} ELSE {_fallback_sql(1, "''")} END AS record FROM recovered""")
def json_fallbacks(spark, sf_dir):
    docs = _uploads(spark, sf_dir).select("session", "doc_id")
    return analysis.recover(_responses(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "analyzer", "record")


@_query(f"""WITH {_SESSIONS}, {_recovered_sql('uploads')} SELECT doc_id, CASE WHEN parsed THEN NULL ELSE TRUE END AS abc_reasonable,
  CASE WHEN parsed THEN NULL WHEN (doc_id + k) % 13 = 0 THEN 'Analysis unavailable' ELSE 'Unable to determine' END AS market_price_range, severity FROM recovered WHERE analyzer = 'market_scope'""")
def typed_market_records(spark, sf_dir):
    docs = _uploads(spark, sf_dir).select("session", "doc_id")
    return analysis.typed_records(analysis.recover(_responses(docs, _table(spark, sf_dir, "labels"))), "market_scope", "doc_id").select("doc_id", "abc_reasonable", "market_price_range", "severity")


_COMPILED = """CASE doc_id % 9 WHEN 0 THEN 'Sure: {"status":"PASS","title":"t"} ok' WHEN 1 THEN '{"status":"PASS"}' WHEN 2 THEN 'no json' WHEN 3 THEN '[1]' WHEN 4 THEN '5'
  WHEN 5 THEN '{"status":"MAYBE","title":"t","confidence":900}' WHEN 6 THEN '{"status":null,"title":"n","confidence":7,"findings":[]}' ELSE '{"status":"FAIL","title":"f"}' END"""


@_query("""SELECT doc_id, CASE k WHEN 0 THEN 'PASS' WHEN 5 THEN 'MAYBE' WHEN 6 THEN NULL ELSE 'FAIL' END AS status,
  CASE WHEN k IN (0, 5) THEN 't' WHEN k = 6 THEN 'n' WHEN k IN (4, 7, 8) THEN 'System Error During Analysis' ELSE 'Analysis Incomplete' END AS title,
  CASE WHEN k = 0 THEN NULL WHEN k = 5 THEN 900 WHEN k = 6 THEN 7 WHEN k IN (4, 7, 8) THEN 0 ELSE 50 END::INT AS confidence,
  CASE WHEN k NOT IN (0, 5, 6) THEN 'System Error' END AS category, CASE k WHEN 7 THEN 'Critical error: timeout' WHEN 8 THEN 'Critical error: No analysis results found in state' END AS item
FROM (SELECT doc_id, doc_id % 9 AS k FROM documents)""")
def verdict_shape(spark, sf_dir):
    answers = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_COMPILED).alias("response"), F.expr("CASE doc_id % 9 WHEN 7 THEN 'timeout' END").alias("error"), F.expr("doc_id % 9 <> 8").alias("some"))
    found = verdict.compile_verdicts(answers, has_results="some")
    first = F.get("verdict.findings", F.lit(0))
    item = F.when(F.expr("doc_id % 9 IN (7, 8)"), F.get(first["items"], F.lit(0)))
    return found.select("doc_id", "verdict.status", "verdict.title", "verdict.confidence", first["category"].alias("category"), item.alias("item"))


def _merged(spark, sf_dir) -> DataFrame:
    docs = _uploads(spark, sf_dir).select("session", "doc_id")
    return analysis.merge_sessions(analysis.recover(_responses(docs, _table(spark, sf_dir, "labels"))), "session")


_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_PIVOT = ", ".join(f"CASE max({_RANK}) FILTER (analyzer = '{a}') WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS {a}" for a in ANALYZERS)
_MERGED = f"""{_SESSIONS}, {_recovered_sql('uploads')}, merged AS (
  SELECT session, {_PIVOT}, count(DISTINCT analyzer)::INT AS n_analyzers, count(DISTINCT analyzer) FILTER (parsed)::INT AS n_parsed FROM recovered GROUP BY session)"""


@_query(f"WITH {_MERGED} SELECT * FROM merged")
def analysis_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


def _verdicts(spark, sf_dir) -> DataFrame:
    return verdict.verdicts(_merged(spark, sf_dir), "session")


_FINDINGS = " UNION ALL ".join(f"SELECT session, {k} AS k, '{verdict.NAMES[a]}' AS category, '{a}' AS analyzer, {a} AS severity FROM merged WHERE {a} IN ('medium', 'high')" for k, a in enumerate(ANALYZERS))
_VERDICT = f"""{_MERGED}, findings AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY k) AS finding_no FROM ({_FINDINGS})), verdict AS (
  SELECT merged.session, CASE WHEN bool_or(coalesce(severity, '') = 'high') THEN 'FAIL' ELSE 'PASS' END AS status, round(100 * any_value(n_parsed) / 6)::INT AS confidence,
    count(severity) AS n_findings, count(severity) FILTER (severity = 'high') AS n_high, coalesce(string_agg(category, ' and ' ORDER BY finding_no) FILTER (finding_no <= 2), '') AS top
  FROM merged LEFT JOIN findings ON merged.session = findings.session GROUP BY merged.session)"""
_TITLE = "CASE status WHEN 'PASS' THEN 'Review Passed' ELSE 'Review Failed' END"
_INTRO = "'Analysis complete: ' || status || ' with ' || confidence || '% confidence. ' || CASE WHEN top = '' THEN 'I can walk you through the key findings.' ELSE 'Key risk areas: ' || top || '.' END || ' Which part should we review first?'"


@_query(f"WITH {_VERDICT} SELECT session, status, {_TITLE} AS title, confidence, n_findings, n_high FROM verdict")
def verdict_by_session(spark, sf_dir):
    high = F.size(F.filter("findings", lambda f: f["severity"] == "high"))
    return _verdicts(spark, sf_dir).select("session", "status", "title", "confidence", F.size("findings").alias("n_findings"), high.alias("n_high"))


@_query(f"""WITH {_VERDICT} SELECT session, finding_no, category, severity, item_no, CASE item_no WHEN 1 THEN 'Review of ' || analyzer ELSE 'Severity ' || severity END AS item
FROM findings, (VALUES (1), (2)) i(item_no)""")
def findings_unnest(spark, sf_dir):
    return verdict.unnest_findings(_verdicts(spark, sf_dir), "session")


@_query(f"WITH {_VERDICT} SELECT session, top AS categories FROM verdict")
def top2_categories(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("session", verdict.top_categories().alias("categories"))


@_query(f"SELECT doc_id, severity, upper(severity) AS shown, CASE severity WHEN 'high' THEN 'Critical Risk' WHEN 'medium' THEN 'Moderate Risk' ELSE 'Minor Issue' END AS label FROM (SELECT doc_id, {_SEVERITY} AS severity FROM labels)")
def severity_labels(spark, sf_dir):
    label = F.create_map(*[F.lit(x) for pair in verdict.LABELS.items() for x in pair])[F.col("severity")]
    return _table(spark, sf_dir, "labels").select("doc_id", F.expr(_SEVERITY).alias("severity")).select("doc_id", "severity", F.upper("severity").alias("shown"), F.coalesce(label, "severity").alias("label"))


_ADVICE = ", ".join(f"('{s}', {k}, '{x}')" for s, lines in verdict.ADVICE.items() for k, x in enumerate(lines, 1))


@_query(f"WITH {_VERDICT} SELECT session, n, recommendation FROM verdict JOIN (VALUES {_ADVICE}) a(s, n, recommendation) ON s = status")
def recommendations(spark, sf_dir):
    return verdict.recommendations(_verdicts(spark, sf_dir), "session")


@_query(f"WITH {_VERDICT} SELECT session, {_INTRO} AS intro FROM verdict")
def verdict_intro(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("session", verdict.intro().alias("intro"))


_LINES = f"""SELECT session, 0.0 AS place, 'heading' AS section, 'PROCUREMENT DOCUMENT ANALYSIS' AS text FROM verdict UNION ALL SELECT session, 1, 'status', 'Status: ' || status FROM verdict
UNION ALL SELECT session, 2, 'confidence', 'Confidence: ' || confidence || '%' FROM verdict UNION ALL SELECT session, 3, 'title', {_TITLE} FROM verdict UNION ALL SELECT session, 4, 'summary', 'Findings: ' || n_findings FROM verdict
UNION ALL SELECT session, 4 + finding_no, 'finding', finding_no || '. ' || category || ' [' || upper(severity) || ']' FROM findings
UNION ALL SELECT session, 4 + finding_no + 0.1 * item_no, 'item', '• ' || CASE item_no WHEN 1 THEN 'Review of ' || analyzer ELSE 'Severity ' || severity END FROM findings, (VALUES (1), (2)) i(item_no)
UNION ALL SELECT session, 100 + n, 'recommendation', '• ' || recommendation FROM verdict JOIN (VALUES {_ADVICE}) a(s, n, recommendation) ON s = status"""


@_query(f"WITH {_VERDICT} SELECT session, (row_number() OVER (PARTITION BY session ORDER BY place) - 1)::INT AS line_no, section, text FROM ({_LINES})")
def report_lines(spark, sf_dir):
    return verdict.report_lines(_verdicts(spark, sf_dir), "session")


_ACTION = "CASE session % 4 WHEN 0 THEN 'generate_gamma' WHEN 3 THEN NULL ELSE 'chat_only' END"


def _resumed(spark, sf_dir) -> DataFrame:
    """Verdicts that one job pauses and another one, in a session of its own, goes on with."""
    folder = scratch(spark, "sessions")
    awaiting = review.pause(verdict_by_session(spark, sf_dir), StateStore(spark, folder, "session"), "verdicts")
    reviews = awaiting.select("session", F.expr(_ACTION).alias("action")).where("action is not null")
    return review.resume_stored(StateStore(spark, folder, "session"), reviews, "decisions")


@_query(f"WITH {_VERDICT} SELECT session, status, CASE WHEN {_ACTION} IS NULL THEN 'awaiting_review' ELSE 'complete' END AS state, CASE {_ACTION} WHEN 'generate_gamma' THEN 'presentation' WHEN 'chat_only' THEN 'end' END AS route FROM verdict")
def review_route(spark, sf_dir):
    return _resumed(spark, sf_dir).select("session", "status", "state", "route")


@_query(f"WITH {_VERDICT} SELECT session, status, CASE WHEN {_ACTION} IS NULL THEN 'awaiting_review' ELSE 'complete' END AS state, CASE {_ACTION} WHEN 'generate_gamma' THEN 'presentation' WHEN 'chat_only' THEN 'end' END AS route, 2 AS version FROM verdict")
def review_resumed(spark, sf_dir):
    """Both jobs run again, each in a session of its own: what is stored stays as it is, and later decisions change nothing."""
    folder = scratch(spark, "sessions")
    store = lambda: StateStore(spark.newSession(), folder, "session")
    for _ in range(2):
        awaiting = review.pause(verdict_by_session(spark, sf_dir), store(), "verdicts")
        review.resume_stored(store(), awaiting.select("session", F.expr(_ACTION).alias("action")).where("action is not null"), "decisions")
    found = StateStore(spark, folder, "session")
    return found.read().select("session", "status", "state", "route", F.lit(found.latest()["version"]).alias("version"))


@_query("SELECT DISTINCT doc_id // 3 AS session, 'complete' AS status, CASE (doc_id // 3) % 8 WHEN 0 THEN 'link ' || (doc_id // 3) END AS link FROM documents WHERE (doc_id // 3) % 4 <> 3")
def review_responses(spark, sf_dir):
    resumed = _resumed(spark, sf_dir)
    links = resumed.select("session", F.expr("CASE session % 8 WHEN 0 THEN concat('link ', session) ELSE '' END").alias("link"))
    return review.review_responses(resumed, "session", links)


@_query(f"WITH {_VERDICT} SELECT w AS session, status FROM (SELECT unnest(range(-2, 4)) AS w) LEFT JOIN verdict ON session = w")
def state_snapshot(spark, sf_dir):
    return review.snapshot(verdict_by_session(spark, sf_dir).select("session", "status"), "session", spark.range(-2, 4).toDF("session"))


# --- models ------------------------------------------------------------------------------------------------

_SENTENCE = """CASE doc_id % 5 WHEN 0 THEN 'Brand X or equivalent, with warranty and energy use stated within the budget. ' WHEN 1 THEN 'Must be made by Y only; sole supplier. '
  WHEN 2 THEN 'Competitive bidding; local preference; recycled parts, low carbon, energy efficient; disposal at end of life. ' ELSE '' END || coalesce(text, '')"""


def _sentences(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_SENTENCE).alias("text"))


def _rules_sql() -> str:
    parts = []
    for a, rules in model.RULES.items():
        hits = [f"CASE WHEN {'NOT ' if s[0] == '-' else ''}regexp_matches(t, '{p}') THEN {SEVERITIES.index(s.lstrip('-')) + 1} ELSE 0 END" for _, p, s in rules]
        labels = ", ".join(f"CASE WHEN {'NOT ' if s[0] == '-' else ''}regexp_matches(t, '{p}') THEN '{'missing' if s[0] == '-' else 'found'}: {x}' END" for x, p, s in rules)
        parts.append(f"SELECT doc_id, '{a}' AS analyzer, CASE greatest({', '.join(hits)}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, concat_ws('; ', {labels}) AS labels FROM s")
    return f"WITH s AS (SELECT doc_id, {_SENTENCE} AS t FROM documents) " + " UNION ALL ".join(parts)


@_query(_rules_sql())
def rules_analysis(spark, sf_dir):
    recovered = analysis.recover(model.provider_responses(_sentences(spark, sf_dir), "doc_id", "text"))
    lists = F.coalesce(*[F.from_json(F.get_json_object("record", f"$.{x}"), "array<string>") for x in sorted(set(model._LISTS.values()))])
    return recovered.select("doc_id", "analyzer", "severity", F.array_join(lists, "; ").alias("labels"))


@_query(f"""WITH r AS ({_rules_sql()}) SELECT doc_id, CASE WHEN bool_or(severity = 'high') THEN 'FAIL' ELSE 'PASS' END AS status, 100 AS confidence, count(*) FILTER (severity <> 'low') AS n_findings FROM r GROUP BY doc_id""")
def rules_verdicts(spark, sf_dir):
    recovered = analysis.recover(model.provider_responses(_sentences(spark, sf_dir), "doc_id", "text"))
    found = verdict.verdicts(analysis.merge_sessions(recovered, "doc_id"), "doc_id")
    return found.select("doc_id", "status", "confidence", F.size("findings").cast("long").alias("n_findings"))


_DOUBLE = lambda x: x.replace("'", "''")
_MARKET = "'Market research for items:' || chr(10) || lang || chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN '(Market search unavailable: no network)' WHEN 1 THEN '(Tavily API not configured - using document analysis only)' ELSE 'Search results:' || chr(10) || '- ' || source || ': ' || coalesce(text, '')[1:200] || chr(10) END"


def _market() -> Column:
    results = F.expr("CASE doc_id % 3 WHEN 2 THEN array(named_struct('title', source, 'content', text)) END")
    return model.market_text(F.col("lang"), results, F.expr("CASE doc_id % 3 WHEN 0 THEN 'no network' END"))


def _prompt_sql(template: str, **values: str) -> str:
    out = re.sub(r"\{(\w+)\}", lambda m: f"' || {values[m[1]]} || '", _DOUBLE(template))
    return f"'{out}'"


@_query("SELECT doc_id, analyzer, md5(prompt) AS prompt_md5, length(prompt) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{a}' AS analyzer, {_prompt_sql(model.TEMPLATES[a], document="coalesce(text, '')", market=f'({_MARKET})')} AS prompt FROM documents" for a in ANALYZERS) + ")")
def analysis_prompts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("market", _market())
    return model.analysis_prompts(docs, "doc_id", "text", "market").select("doc_id", "analyzer", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n"))


@_query(f"SELECT doc_id, md5({_MARKET}) AS market_md5, 'Philippines market price ' || lang AS query FROM documents")
def market_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(_market()).alias("market_md5"), model.market_query(F.col("lang")).alias("query"))


def _lengths(batches):
    """A model that tells how long its prompt is, and fails on some."""
    for b in batches:
        n = b["prompt"].str.len()
        yield b[["prompt_hash"]].assign(response=[str(x) if x % 10 else None for x in n], error=["round number" if x % 10 == 0 else None for x in n])


@_query(f"""SELECT conv_id, turn, CASE WHEN n % 10 <> 0 THEN n::VARCHAR END AS response, CASE WHEN n % 10 = 0 THEN 'round number' END AS error
FROM (SELECT conv_id, turn, length({_prompt_sql(model.TEMPLATES['chat'], document="role", report="'{query}'", query="text")}) AS n FROM conversations)""")
def chat_answers(spark, sf_dir):
    asked = _table(spark, sf_dir, "conversations").select("conv_id", "turn", model.chat_prompt(F.col("role"), F.lit("{query}"), F.col("text")).alias("prompt"))
    return model.run_model(asked, _lengths, "chat").select("conv_id", "turn", "response", "error")


@_query("SELECT doc_id, length('" + _DOUBLE(model.TEMPLATES["items"]).replace("{document}", "") + "' || coalesce(text, '')[1:3000])::VARCHAR AS items FROM documents")
def market_items(spark, sf_dir):
    def count(batches):
        for b in batches:
            yield b[["prompt_hash"]].assign(response=b["prompt"].str.len().astype(str), error=None)

    return model.run_model(model.items_prompts(_table(spark, sf_dir, "documents"), "doc_id", "text"), count, "items").select("doc_id", F.col("response").alias("items"))


# --- progress logs ---------------------------------------------------------------------------------


def _logs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("agent"), F.col("props").alias("message"), "ts", (F.col("event_type") == "error").alias("failed"))


_NAMES = "CASE agent WHEN 'view' THEN 'Document Extraction' WHEN 'click' THEN 'Cost Analysis' ELSE agent END"


@_query(f"""WITH l AS (SELECT user_id, event_type AS agent, arg_max(props, event_id) AS message, min(event_id) AS first_seq, max(event_id) AS last_seq, arg_min(ts, event_id) AS first_ts, arg_max(ts, event_id) AS last_ts FROM events GROUP BY ALL)
SELECT user_id, agent, message, first_seq, last_seq, first_ts, last_ts, {_NAMES} AS shown, row_number() OVER (PARTITION BY user_id ORDER BY first_seq) AS lane,
  CASE WHEN last_seq = max(last_seq) OVER (PARTITION BY user_id) AND user_id % 3 <> 0 THEN 'active' ELSE 'complete' END AS status FROM l""")
def agent_lanes(spark, sf_dir):
    lanes = progress.agent_lanes(_logs(spark, sf_dir), "user_id", "agent", complete=F.col("user_id") % 3 == 0, ts="ts")
    named = F.when(F.col("agent") == "view", "PDF Parser").when(F.col("agent") == "click", "LCCA Analyzer").otherwise(F.col("agent"))
    return lanes.withColumn("shown", progress.display_name(named))


@_query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM events WHERE event_id % 2 = 0 OR user_id % 2 = 0")
def logs_appended(spark, sf_dir):
    logs = _logs(spark, sf_dir).select("seq", "user_id")
    side = lambda rows, name: rows.select("seq", F.lit(name).alias("side"))
    return progress.append_logs(side(logs.where("seq % 2 = 0"), "left"), side(logs.where("seq % 2 = 1 and user_id % 2 = 0"), "right"))


_ENDS = "CASE user_id % 5 WHEN 0 THEN '{\"status\":\"PASS\"}' WHEN 1 THEN 'no json' ELSE '' END"


@_query(f"""WITH s AS (SELECT user_id, {_ENDS} AS report, CASE WHEN user_id % 5 = 2 THEN 'task died' END AS error, user_id % 5 = 3 AS timed_out FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, event_id AS seq, 'thinking_log' AS event, '{{"id":"' || event_id || '","agent":"' || event_type || '","message":"m","timestamp":' || event_id || ',"status":"active"}}' AS data FROM events
UNION ALL SELECT user_id, 9223372036854775805, CASE WHEN report LIKE '{{%' THEN 'verdict' ELSE 'error' END, CASE WHEN report LIKE '{{%' THEN report ELSE '{{"error":"' || CASE WHEN report <> '' THEN 'Invalid verdict format' WHEN error IS NOT NULL THEN error ELSE 'Analysis timeout' END || '"}}' END
FROM s WHERE report <> '' OR error IS NOT NULL OR timed_out UNION ALL SELECT user_id, 9223372036854775806, 'complete', '{{"status":"awaiting_review"}}' FROM s WHERE report LIKE '{{%'""")
def analysis_events(spark, sf_dir):
    logs = _logs(spark, sf_dir).select("user_id", "seq", F.col("seq").cast("string").alias("id"), "agent", F.lit("m").alias("message"), F.col("seq").alias("timestamp"), F.lit("active").alias("status"))
    sessions = logs.select("user_id").distinct().selectExpr("user_id", f"{_ENDS} AS report", "CASE WHEN user_id % 5 = 2 THEN 'task died' END AS error", "user_id % 5 = 3 AS timed_out")
    return progress.analysis_events(logs, sessions, "user_id")


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'complete' WHEN c_custkey % 3 = 0 THEN 'processing' ELSE 'not_started' END AS status, c_custkey % 3 = 1 AS has_verdict, c_custkey % 6 = 1 AS has_gamma, c_nationkey::BIGINT AS thinking_logs_count FROM customer""")
def session_report(spark, sf_dir):
    report, link = F.expr("CASE c_custkey % 3 WHEN 1 THEN '{}' ELSE '' END"), F.expr("CASE c_custkey % 6 WHEN 1 THEN 'x' END")
    found = progress.status_of(F.expr("c_custkey % 3 = 0"), report, link, F.col("c_nationkey").cast("long"))
    return _table(spark, sf_dir, "customer").select("c_custkey", found.alias("s")).select("c_custkey", "s.*")


_UI = {"has_thread": "k % 2 = 1", "has_verdict": "k // 2 % 2 = 1", "generating": "k // 4 % 2 = 1", "reviewed": "k // 8 % 2 = 1", "failed": "k // 16 % 2 = 1", "uploading": "k // 32 % 2 = 1"}


@_query("""SELECT event_id, CASE WHEN v THEN CASE WHEN r THEN 'complete' WHEN g AND NOT f THEN 'generating' ELSE 'verdict' END WHEN f THEN 'idle' WHEN t THEN 'thinking' WHEN u THEN 'uploading' ELSE 'idle' END AS state FROM (SELECT event_id, """
        + ", ".join(f"{x.replace('k ', 'event_id ')} AS {n}" for n, x in zip("tvgrfu", _UI.values())) + " FROM events)")
def ui_states(spark, sf_dir):
    facts = {name: F.expr(sql.replace("//", "div")) for name, sql in _UI.items()}
    return _table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("k")).select("event_id", review.ui_state(**facts).alias("state"))


_SENT = """CASE event_type WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'upload' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'upload_failed' ELSE 'reset' END WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'stream_complete' ELSE 'verdict' END
  WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'generate' WHEN 1 THEN 'generated' WHEN 2 THEN 'generate_failed' ELSE 'declined' END WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'stream_error' END ELSE 'thinking_log' END"""


@_query(f"""WITH e AS (
  SELECT user_id, event_id, coalesce({_SENT}, '') AS kind FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), f AS (
  SELECT user_id, count(*) AS n_events, list_reduce(list_prepend('idle|0|0', list(kind ORDER BY event_id)), lambda s, e:
    CASE WHEN e = 'upload' THEN 'uploading|' || split_part(s, '|', 2) || '|' || split_part(s, '|', 3)
      WHEN e = 'uploaded' THEN 'thinking|1|1'
      WHEN e = 'upload_failed' THEN 'idle|' || split_part(s, '|', 2) || '|' || split_part(s, '|', 3)
      WHEN e = 'verdict' AND split_part(s, '|', 3) = '1' THEN 'verdict|' || split_part(s, '|', 2) || '|1'
      WHEN e = 'stream_complete' THEN split_part(s, '|', 1) || '|' || split_part(s, '|', 2) || '|0'
      WHEN e = 'stream_error' AND split_part(s, '|', 3) = '1' THEN 'idle|' || split_part(s, '|', 2) || '|0'
      WHEN e = 'generate' AND split_part(s, '|', 2) = '1' THEN 'generating|1|' || split_part(s, '|', 3)
      WHEN e IN ('generated', 'declined') AND split_part(s, '|', 2) = '1' THEN 'complete|1|' || split_part(s, '|', 3)
      WHEN e = 'generate_failed' AND split_part(s, '|', 2) = '1' THEN 'verdict|1|' || split_part(s, '|', 3)
      WHEN e = 'reset' THEN 'idle|0|0' ELSE s END) AS s
  FROM e GROUP BY user_id
) SELECT user_id, n_events, split_part(s, '|', 1) AS state, split_part(s, '|', 2) = '1' AS has_session, split_part(s, '|', 3) = '1' AS connected FROM f""")
def session_ui_states(spark, sf_dir):
    sent = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return session_states.session_states(sent.withColumn("kind", F.expr(_SENT)), "user_id", "event_id", "kind")


@_query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'upload' WHEN trim(m) = '' THEN 'none' WHEN s IN ('verdict', 'complete') THEN 'chat' WHEN s = 'idle' THEN 'remind' ELSE 'none' END AS route
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '  ' ELSE text END AS m, CASE conv_id % 4 WHEN 0 THEN 'verdict' WHEN 1 THEN 'complete' WHEN 2 THEN 'idle' ELSE 'thinking' END AS s FROM conversations)""")
def send_routes(spark, sf_dir):
    state = F.expr("CASE conv_id % 4 WHEN 0 THEN 'verdict' WHEN 1 THEN 'complete' WHEN 2 THEN 'idle' ELSE 'thinking' END")
    route = review.send_route(F.expr("CASE WHEN turn % 5 = 0 THEN 2 ELSE 0 END"), state, F.expr("CASE turn % 3 WHEN 2 THEN '  ' ELSE text END"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("route"))


@_query("SELECT event_id, user_id, value FROM events")
def log_dedup(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lit(1).alias("seq"))
    replayed = events.where("user_id % 5 = 0").withColumn("value", F.lit(-1.0)).withColumn("seq", F.lit(2))
    return progress.first_by_id(events.union(replayed), "event_id", "seq").select("event_id", "user_id", "value")


@_query("SELECT event_id AS seq, event_type AS agent, status FROM events, (VALUES ('active'), ('complete')) s(status)")
def active_complete_logs(spark, sf_dir):
    return progress.active_and_complete(_logs(spark, sf_dir)).select("seq", "agent", "status")


_FACTS = """facts AS (SELECT user_id, count(*) AS n_logs, count(*) FILTER (event_type = 'error') AS n_errors, (epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT) AS span_s,
  bool_or(event_type = 'purchase') AS has_verdict FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) GROUP BY user_id)"""


def _facts(spark, sf_dir) -> DataFrame:
    logs = _logs(spark, sf_dir).withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return progress.thread_facts(logs, "user_id", "ts").join(logs.groupBy("user_id").agg(F.bool_or(F.col("agent") == "purchase").alias("has_verdict")), "user_id")


@_query(f"WITH {_FACTS} SELECT c_custkey AS user_id, coalesce(n_logs, 0) AS n_logs, CASE WHEN has_verdict THEN 'complete' WHEN n_logs > 0 THEN 'processing' ELSE 'not_started' END AS status FROM customer LEFT JOIN facts ON c_custkey = user_id")
def session_status(spark, sf_dir):
    sessions = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    joined = sessions.join(_facts(spark, sf_dir), "user_id", "left")
    return joined.select("user_id", F.coalesce("n_logs", F.lit(0)).alias("n_logs"), progress.session_status(F.col("n_logs") > 0, F.coalesce("has_verdict", F.lit(False))).alias("status"))


@_query(f"WITH {_FACTS} SELECT user_id, span_s, span_s > 300 AS timed_out FROM facts")
def timeout_sessions(spark, sf_dir):
    return _facts(spark, sf_dir).select("user_id", "span_s", "timed_out")


@_query(f"WITH {_FACTS} SELECT user_id, CASE WHEN has_verdict THEN 'complete' WHEN n_errors > 0 THEN 'error' WHEN span_s > 300 THEN 'timeout' ELSE 'open' END AS event FROM facts")
def terminal_event(spark, sf_dir):
    return _facts(spark, sf_dir).select("user_id", progress.terminal_event(F.col("has_verdict"), F.col("n_errors"), F.col("timed_out")).alias("event"))


@_query(r"SELECT event_id, event_type AS event, props || chr(10) || value AS data FROM (SELECT event_id, event_type, props, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) AS value FROM events)")
def sse_frames(spark, sf_dir):
    frame = F.concat(F.lit(": keep-alive\r\nevent: first\r\nevent: "), "event_type", F.lit("\r\ndata: "), "props", F.lit("\ndata:"), F.round(F.col("value") * 100).cast("long").cast("string"))
    parsed = _table(spark, sf_dir, "events").select("event_id", chat.parse_frame(frame).alias("f"))
    return parsed.select("event_id", "f.event", "f.data")


_STREAM = "': hello' || chr(13) || chr(10) || chr(13) || chr(10) || 'event: chat_start' || chr(10) || 'data: {\"n\": ' || event_id || '}' || chr(13) || chr(10) || chr(13) || chr(10) || 'event: bad' || chr(10) || 'data: x ' || chr(10) || chr(10) || 'data: [1,' || chr(10) || 'data: 2]' || chr(10) || chr(10) || 'data: 9'"


@_query("""SELECT event_id, frame_no::INT AS frame_no, CASE frame_no WHEN 1 THEN 'chat_start' ELSE 'bad' END AS event,
  CASE frame_no WHEN 1 THEN '{"n":' || event_id || '}' END AS payload, CASE frame_no WHEN 2 THEN 'Failed to parse stream payload' END AS problem FROM events, (VALUES (1), (2)) f(frame_no)""")
def stream_frames(spark, sf_dir):
    return chat.stream_frames(_table(spark, sf_dir, "events").select("event_id", F.expr(_STREAM).alias("body")), "event_id", "body")


@_query("SELECT event_id, user_id, event_type FROM events")
def stream_log_tail(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    stream = log_tail.table_stream(spark, sf_dir, "events.parquet", schema)
    # what there is ends, and its files come in any order: repeats go afterwards, so that no row is late
    return log_tail.drain(stream.select("event_id", "user_id", "event_type"), shared_folder(spark)).dropDuplicates(["event_id"])


@_query("""SELECT e.event_id, e.user_id, event_type FROM events e JOIN (SELECT user_id, max(event_id) - 10 * user_id AS seen FROM events GROUP BY user_id) c ON e.user_id = c.user_id AND e.event_id > seen""")
def log_replay(spark, sf_dir):
    """Clients that come back: each gets the logs of its session behind the last one that it has seen."""
    folder = scratch(spark, "logs")
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    log_store.write_logs(rows, folder, "user_id", "event_id")
    seen = rows.groupBy("user_id").agg(F.max("event_id").alias("top")).select("user_id", F.expr("top - 10 * user_id").alias("after"))
    return log_store.replay_all(spark, folder, seen, "user_id", "event_id")


_CHUNKED = """concat('event: chat_start\\r\\ndata: {"n":', turn, '}\\r\\n\\r\\n: keep-alive\\n\\nevent: chat_delta\\ndata: ', to_json(named_struct('delta', text)), '\\n\\n',
  CASE WHEN role = 'user' THEN 'event: error\\ndata: {"error":"gone"}\\n\\n' WHEN turn % 4 = 1 THEN 'data: NaN\\n\\n' ELSE '' END, 'event: chat_complete\\ndata: {"delta":1}\\n\\nevent: cut\\ndata: 2')"""


@_query("""SELECT conv_id * 1000 + turn AS message_id, frame_no, CASE frame_no WHEN 0 THEN 'chat_start' WHEN 2 THEN 'chat_delta' ELSE CASE WHEN role = 'user' THEN 'error' WHEN turn % 4 = 1 THEN 'message' ELSE 'chat_complete' END END AS event,
  CASE frame_no WHEN 2 THEN md5(text) WHEN 3 THEN CASE WHEN role <> 'user' AND turn % 4 <> 1 THEN md5('1') END END AS delta_md5,
  CASE WHEN frame_no = 3 AND role = 'user' THEN 'gone' WHEN frame_no = 3 AND turn % 4 = 1 THEN 'Failed to parse stream payload' END AS problem
FROM conversations, (VALUES (0::BIGINT), (2), (3)) f(frame_no)""")
def frames_of_chunks(spark, sf_dir):
    """Streams that arrive in chunks of 11 bytes, cut anywhere, and end at a client's first problem."""
    bodies = _table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("message_id"), F.encode(F.expr(_CHUNKED), "UTF-8").alias("body"))
    cut = bodies.select("message_id", F.expr("inline(transform(sequence(0, (octet_length(body) - 1) div 11), i -> struct(i AS seq, substring(body, cast(i * 11 + 1 as int), 11) AS chunk)))"))
    found = frames.chunked_frames(cut, "message_id", "seq", "chunk")
    return found.select("message_id", "frame_no", "event", F.md5(F.get_json_object("payload", "$.delta")).alias("delta_md5"), "problem")


# --- chat --------------------------------------------------------------------------------------------


@_query("SELECT conv_id, count(*) AS n_deltas, md5(string_agg(text, '' ORDER BY turn)) AS response_md5 FROM conversations WHERE text <> '' GROUP BY conv_id")
def chat_reassemble(spark, sf_dir):
    return chat.reassemble(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "n_deltas", F.md5("response").alias("response_md5"))


_FINALS = "SELECT conv_id, 'final ' || conv_id AS response FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id"
_DELTA = "CASE WHEN turn = 0 THEN '  ' WHEN turn % 4 = 1 THEN '' ELSE text END"


@_query(f"""WITH d AS (SELECT conv_id, turn, {_DELTA} AS delta FROM conversations), f AS ({_FINALS}),
j AS (SELECT conv_id, string_agg(delta, '' ORDER BY turn) FILTER (turn >= first) AS said FROM (SELECT *, min(turn) FILTER (trim(delta) <> '') OVER (PARTITION BY conv_id) AS first FROM d) GROUP BY conv_id)
SELECT j.conv_id, md5(coalesce(response, said)) AS content_md5 FROM j LEFT JOIN f ON j.conv_id = f.conv_id WHERE coalesce(response, said) IS NOT NULL""")
def chat_shown(spark, sf_dir):
    deltas = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_DELTA).alias("delta"))
    finals = deltas.where("conv_id % 3 = 0").groupBy("conv_id").agg(F.concat(F.lit("final "), F.first("conv_id").cast("string")).alias("response"))
    return chat.shown_messages(deltas, finals, "conv_id", "turn", "delta").select("conv_id", F.md5("content").alias("content_md5"))


@_query("SELECT conv_id, min(turn) AS turn, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def chat_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return chat.upsert(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), "conv_id", "turn").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@_query("""WITH e AS (SELECT conv_id, max(turn) AS n, conv_id % 4 = 1 AS gone, CASE WHEN conv_id % 4 = 2 THEN 'died' END AS error FROM conversations GROUP BY conv_id)
SELECT conv_id, -1::BIGINT AS seq, 'chat_start' AS event, '{"message_id":' || conv_id || ',"timestamp":' || n || '}' AS data FROM e
UNION ALL SELECT conv_id, turn, 'chat_delta', '{"message_id":' || conv_id || ',"delta":"' || role || '"}' FROM conversations
UNION ALL SELECT e.conv_id, 9223372036854775807, CASE WHEN error IS NULL THEN 'chat_complete' ELSE 'error' END, CASE WHEN error IS NULL THEN '{"message_id":' || e.conv_id || ',"response":"' || said || '","timestamp":' || n || '}' ELSE '{"message_id":' || e.conv_id || ',"error":"died"}' END
FROM e JOIN (SELECT conv_id, string_agg(role, '' ORDER BY turn) AS said FROM conversations GROUP BY conv_id) r ON e.conv_id = r.conv_id WHERE NOT gone""")
def chat_events(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("started"), F.max("turn").alias("ended")).withColumns({"disconnected": F.expr("conv_id % 4 = 1"), "error": F.expr("CASE WHEN conv_id % 4 = 2 THEN 'died' END")})
    return chat.chat_events(rows, ends, "conv_id", "turn", "role")


@_query("""WITH m AS (
  SELECT conv_id * 1000 + turn AS message_id, turn, role, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '(?s).{1,60}') END AS pieces FROM conversations
), e AS (
  SELECT message_id, -1::BIGINT AS seq, 'chat_start' AS event, '{"message_id":' || message_id || ',"timestamp":' || turn || '}' AS data FROM m
  UNION ALL SELECT message_id, i - 1, 'chat_delta', '{"message_id":' || message_id || ',"delta":' || CAST(to_json(pieces[i]) AS VARCHAR) || '}' FROM (SELECT message_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM m)
  UNION ALL SELECT message_id, 9223372036854775807, 'chat_complete', '{"message_id":' || message_id || ',"response":' || CAST(to_json(text) AS VARCHAR) || ',"timestamp":' || turn || '}' FROM m WHERE role <> 'user' AND text <> ''
  UNION ALL SELECT message_id, 9223372036854775807, 'error', '{"message_id":' || message_id || ',"error":"no answer"}' FROM m WHERE role <> 'user' AND text = ''
) SELECT message_id, seq, event, md5(data) AS data_md5 FROM e""")
def chat_stream_events(spark, sf_dir):
    """Each turn as an answer that is generated piece by piece: its rows come out of order, in several micro-batches."""
    turns = _table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    end = "CASE WHEN role = 'user' THEN 'gone' WHEN text = '' THEN 'error' ELSE 'complete' END"
    row = "struct(cast({} as long) AS seq, {} AS kind, {} AS delta)".format
    pieces = turns.select("*", F.expr("regexp_extract_all(text, '(?s).{1,60}', 0)").alias("pieces"))
    each = F.expr(f"inline(concat(array({row(-1, repr('start'), 'cast(null as string)')}), transform(pieces, (p, i) -> {row('i', repr('delta'), 'p')}), array({row('size(pieces)', end, repr('no answer'))})))")
    rows = pieces.select(F.expr("conv_id * 1000 + turn").alias("message_id"), F.col("turn").cast("long").alias("timestamp"), each)
    dealt = durable(rows.repartition(9, "message_id", "seq"), "chat-rows")
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 3).parquet(dealt.durable_path)
    folder = scratch(spark, "chat")
    events.chat_sink(stream, folder, once=True, silence=RECORDED).awaitTermination()
    return events.events_of(spark, folder).select("message_id", "seq", "event", F.md5("data").alias("data_md5"))


_CONTENT = """CASE turn % 6 WHEN 0 THEN '"' || role || '"' WHEN 1 THEN '["a", {"type": "text", "text": "' || role || '"}, [null, "c"]]' WHEN 2 THEN '{"text": 5, "content": {"text": "' || role || '"}}'
  WHEN 3 THEN '{"other": 1}' WHEN 4 THEN '12' ELSE role END"""


@_query("SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN 'a' || role || 'c' WHEN 3 THEN '' WHEN 4 THEN '12' ELSE role END AS text FROM conversations")
def content_flatten(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", flat_content(F.expr(_CONTENT)).alias("text"))


@_query("SELECT section, n FROM (SELECT 0 AS section, count(*) AS n FROM conversations WHERE role = 'system' UNION ALL SELECT 1, count(*) FROM conversations WHERE role = 'assistant' UNION ALL SELECT 2, count(*) FROM conversations WHERE role = 'user')")
def message_sections(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parts = [rows.where(F.col("role") == r) for r in ("system", "assistant", "user")]
    return chat.message_list(*parts, "turn").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'error ' || conv_id WHEN turn % 3 = 0 THEN 'detail' ELSE 'HTTP 404: Not Found' END AS message FROM conversations")
def http_errors(spark, sf_dir):
    body = F.expr("""CASE WHEN turn % 2 = 0 THEN '{"error": "error ' || conv_id || '", "detail": "d"}' WHEN turn % 3 = 0 THEN '{"error": "", "detail": "detail"}' ELSE 'no json' END""")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.http_error(F.lit(404), F.lit("Not Found"), body).alias("message"))


@_query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'ai' END AS type FROM conversations")
def chat_role_type(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.message_type(F.col("role")).alias("type"))


_MARKED = "CASE turn % 5 WHEN 0 THEN '# ' WHEN 1 THEN '* ' WHEN 2 THEN '-- ' WHEN 3 THEN '### ' ELSE '' END || text || chr(10) || chr(10) || '- **note** ' || role || CASE turn % 2 WHEN 0 THEN chr(10) || ' ' ELSE '' END"
_TRIM = lambda x: rf"regexp_replace({x}, {_STRIP})"


@_query(rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS line_no, len(string_split(x, chr(10))) - 1 AS last FROM (SELECT conv_id, turn, {_MARKED} AS x FROM conversations)
), k AS (SELECT conv_id, turn, line_no, last, {_TRIM('line')} AS t FROM l
), c AS (SELECT *, CASE WHEN t LIKE '### %' THEN 'h3' WHEN t LIKE '## %' THEN 'h2' WHEN t LIKE '# %' THEN 'h1' WHEN t LIKE '*%' AND t NOT LIKE '**%' OR t LIKE '-%' AND t NOT LIKE '--%' THEN 'bullet' WHEN t = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM k)
SELECT conv_id, turn, line_no, kind, md5(CASE WHEN kind IN ('h1', 'h2', 'h3') THEN regexp_replace(t, '^#+ ', '') WHEN kind = 'bullet' THEN {_TRIM('t[2:]')} ELSE t END) AS text_md5 FROM c WHERE kind <> 'blank' OR line_no < last""")
def markdown_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.markdown_lines(F.expr(_MARKED))).alias("line_no", "c"))
    return lines.select("conv_id", "turn", "line_no", "c.kind", F.md5("c.text").alias("text_md5"))


_BOLD = "'**' || role || ':** **' || replace(text, '*', '') || CASE turn % 2 WHEN 0 THEN ' **end**' ELSE ' 2 ** 3' END"


@_query("""SELECT conv_id, turn, pos, bold, md5(part) AS text_md5 FROM (SELECT conv_id, turn, unnest([role || ':', CASE turn % 2 WHEN 0 THEN t || ' ' ELSE t || ' 2 ** 3' END, CASE turn % 2 WHEN 0 THEN 'end' END]) AS part,
  unnest([TRUE, FALSE, TRUE]) AS bold, unnest([0, 1, 2]) AS pos FROM (SELECT conv_id, turn, role, replace(text, '*', '') AS t FROM conversations)) WHERE part IS NOT NULL""")
def bold_spans(spark, sf_dir):
    parts = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.bold_parts(F.expr(_BOLD))).alias("pos", "p"))
    return parts.select("conv_id", "turn", "pos", "p.bold", F.md5("p.text").alias("text_md5"))


@_query("SELECT conv_id, turn, CASE WHEN length(q) < 1 OR length(q) > 5000 THEN 'bad_length' WHEN trim(q) = '' THEN 'empty' ELSE 'ok' END AS verdict FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '   ' WHEN 2 THEN repeat(text, 9) ELSE text END AS q FROM conversations)")
def query_gate(spark, sf_dir):
    asked = F.expr("CASE turn % 4 WHEN 3 THEN '   ' WHEN 2 THEN repeat(text, 9) ELSE text END")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.query_gate(asked).alias("verdict"))


# --- pages ---------------------------------------------------------------------------------------------

_MESSAGE = "CASE page_id % 3 WHEN 0 THEN 'File ' || page_id || ' is too large' WHEN 1 THEN 'No such Path: ' || page_id ELSE 'Cannot read ' || url END"


@_query(f"SELECT page_id, CASE WHEN lower(m) LIKE '%path%' OR contains(m, '/') OR contains(m, chr(92)) THEN 'Invalid file format or size' ELSE m END AS message FROM (SELECT page_id, {_MESSAGE} AS m FROM pages)")
def error_redact(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.expr(_MESSAGE).alias("m")).select("page_id", T.redact_error(F.col("m")).alias("message"))


@_query(r"""SELECT page_id, CASE WHEN s = '' THEN 'document.pdf' WHEN length(s) > 255 THEN left(s, 200) || right(s, 50) ELSE s END AS name
FROM (SELECT page_id, ltrim(regexp_replace(string_split(rtrim(u, '/'), '/')[-1], '[^a-zA-Z0-9._-]', '_', 'g'), '.') AS s FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/../.we ird.pdf' WHEN 1 THEN repeat('a', 300) || '.pdf' ELSE url || '/' END AS u FROM pages))""")
def safe_filename(spark, sf_dir):
    path = F.expr("CASE page_id % 3 WHEN 0 THEN url || '/../.we ird.pdf' WHEN 1 THEN repeat('a', 300) || '.pdf' ELSE url || '/' END")
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_filename(path).alias("name"))


# pages share urls, so an id is made of both
_MD5 = "md5(concat_ws(' ', page_id, url))"
_ID = f"""CASE page_id % 5 WHEN 0 THEN {_MD5} WHEN 1 THEN '{{' || {_MD5} || '}}' WHEN 2 THEN 'urn:uuid:' || regexp_replace({_MD5}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-') WHEN 3 THEN '../' || {_MD5} ELSE substring({_MD5}, 1, 31) END"""


@_query("SELECT page_id, page_id % 5 < 3 AS valid FROM pages")
def thread_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.valid_thread_id(F.expr(_ID)).alias("valid"))


@_query("SELECT page_id FROM pages WHERE page_id % 5 < 3 AND page_id % 2 = 0")
def sessions_existing(spark, sf_dir):
    sessions = _table(spark, sf_dir, "pages").select("page_id", F.expr(_ID).alias("thread_id"))
    files = sessions.select("thread_id", F.expr("CASE page_id % 2 WHEN 0 THEN 'a.PDF' ELSE '.pdf' END").alias("name"))
    return intake.existing_sessions(sessions, files, "thread_id", "name").select("page_id")


@_query("""SELECT page_id, page_id // 3 AS thread, CASE page_id % 3 WHEN 0 THEN 'page.pdf' WHEN 1 THEN CASE WHEN page_id - 1 IN (SELECT page_id FROM pages) THEN 'page_1.pdf' ELSE 'page.pdf' END ELSE 'page_2.PDF' END AS stored FROM pages""")
def stored_names(spark, sf_dir):
    named = F.expr("CASE page_id % 3 WHEN 0 THEN 'page.txt' WHEN 1 THEN '/x/page.pdf' ELSE 'page 2.PDF' END")
    uploads = _table(spark, sf_dir, "pages").select(F.expr("page_id div 3").alias("thread"), "page_id", named.alias("name"))
    return intake.stored_names(uploads, "thread", "page_id", "name").select("page_id", "thread", "stored")


@_query("SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 3 ELSE 2 END AS n_files, page_id % 4 > 1 AS overflow, CASE WHEN page_id % 4 > 0 THEN 2 ELSE 1 END AS n_left FROM pages")
def pending_files(spark, sf_dir):
    added = F.expr("slice(array('c', 'd', 'e'), 1, cast(page_id % 4 as int))")
    found = intake.pending_files(F.array(F.lit("a"), F.lit("b")), added)
    rows = _table(spark, sf_dir, "pages").select("page_id", found.alias("f"))
    return rows.select("page_id", F.size("f.files").alias("n_files"), "f.overflow", F.size(intake.without_file(F.col("f.files"), F.lit(0))).alias("n_left"))


@_query("SELECT doc_id FROM documents WHERE lang = 'en'")
def picked_files(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE lang WHEN 'en' THEN 'application/pdf' WHEN 'fr' THEN 'application/pdf; x' WHEN 'de' THEN NULL ELSE '' END").alias("mime"))
    return intake.picked_files(files, "mime").select("doc_id")


@_query("""SELECT page_id, CASE WHEN n > 1 THEN 'Please analyze these procurement documents (' || n || ' files)' ELSE 'Please analyze this procurement document' END AS content, url || CASE WHEN n > 1 THEN ' +' || (n - 1) || ' more' ELSE '' END AS file_name,
  'Procurement Analysis Report - ' || url[1:8] AS title, CASE page_id % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'w' WHEN 2 THEN 'base/' || page_id END AS link FROM (SELECT *, page_id % 3 + 1 AS n FROM pages)""")
def front_texts(spark, sf_dir):
    response = F.expr("""CASE page_id % 4 WHEN 0 THEN '{"webUrl": "w", "url": "u"}' WHEN 1 THEN '{"webUrl": "w", "id": 1}' WHEN 2 THEN '{"id": ' || page_id || '}' ELSE '{}' END""")
    said = T.upload_message(F.expr("page_id % 3 + 1"), F.col("url"))
    rows = _table(spark, sf_dir, "pages").select("page_id", said.alias("s"), T.presentation_title(F.col("url")).alias("title"), T.presentation_link(response, "base/").alias("link"))
    return rows.select("page_id", "s.content", "s.file_name", "title", "link")


@_query(f"WITH {_VERDICT} SELECT session, status = 'FAIL' AS asks_for_steps FROM verdict")
def follow_up(spark, sf_dir):
    return verdict_by_session(spark, sf_dir).select("session", T.follow_up(F.col("status")).startswith("Which steps").alias("asks_for_steps"))
