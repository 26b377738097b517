"""Reported facts, rendered filings, question suites and their grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import facts as O
from evidentia.operators import qa as Q
from evidentia.session import stage
from evidentia.sources import readers as R
from evidentia.sources import tables as V


def _by_year(spark, sf_dir):
    return O.original_by_year(V.company_facts(spark, sf_dir))


def _cells(spark, sf_dir):
    """Cells of every company, staged: suite and documents are both built from them."""
    return stage(O.metric_cells(O.label_tags(_by_year(spark, sf_dir))), "cells", "ticker")


def original(spark, sf_dir):
    return O.original_filing(V.company_facts(spark, sf_dir)).select("ticker", "tag", "fy", "form", "val", "filed", "accn")


def original_by_year(spark, sf_dir):
    return _by_year(spark, sf_dir).select("ticker", "tag", "fy", "form", "val", "filed", "accn")


def fallback(spark, sf_dir):
    out = O.tag_fallback(O.original_filing(V.company_facts(spark, sf_dir)))
    return out.select("ticker", "field", "tag", "fy", "val")


def labels(spark, sf_dir):
    return O.label_tags(_by_year(spark, sf_dir)).groupBy("ticker", "label", "tag").agg(F.count("fy").alias("n_years"))


def provenance(spark, sf_dir):
    return O.company_provenance(O.metric_cells(O.label_tags(_by_year(spark, sf_dir)))).select(
        "ticker", "a", "b", "reported", "absent")


def skipped(spark, sf_dir):
    return O.skipped_companies(O.metric_cells(O.label_tags(_by_year(spark, sf_dir))))


def documents(spark, sf_dir):
    return Q.render_documents(_cells(spark, sf_dir)).select("ticker", "doc_id", "text")


def suite(spark, sf_dir):
    return Q.build_suite(_cells(spark, sf_dir))


def numbered(spark, sf_dir):
    return Q.number_in_order(Q.build_suite(_cells(spark, sf_dir)), ["ticker", "ord"]).select("qid", "ticker", "ord", "text")


def stats(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return Q.suite_stats(Q.build_suite(c), Q.render_documents(c))


def audit(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return Q.suite_audit(Q.build_suite(c), Q.render_documents(c))


def prompts(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return Q.render_prompt(Q.build_suite(c), Q.render_documents(c))


def _graded(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return Q.grade(Q.answer_all(Q.lookup(Q.build_suite(c), Q.render_documents(c))))


def figures(spark, sf_dir):
    out = Q.document_figures(Q.render_documents(_cells(spark, sf_dir)))
    return out.select("ticker", "doc_id", "low", "year", "figure")


def question_terms(spark, sf_dir):
    s = Q.build_suite(_cells(spark, sf_dir))
    return s.select("ticker", "ord", F.array_join(X.terms(F.col("text")), " ").alias("terms"), X.year_of(F.col("text")).alias("year"))


def looked_up(spark, sf_dir):
    c = _cells(spark, sf_dir)
    out = Q.lookup(Q.build_suite(c), Q.render_documents(c))
    return out.select("ticker", "ord", F.col("asked.v").alias("asked"), F.col("asked.d").alias("asked_doc"),
                      F.col("blind.v").alias("blind"), F.col("first_number.v").alias("first_number"))


def grades(spark, sf_dir):
    return _graded(spark, sf_dir).select(
        "answerer", "ticker", "ord", "answer", "ok", "correct_value", "took_trap", "refused", "failure",
        "citation_correct", F.array_join("fabricated", ",").alias("fabricated"), F.array_join("cited", ",").alias("cited"))


def scores(spark, sf_dir):
    return Q.score(_graded(spark, sf_dir)).withColumn("category", F.coalesce("category", F.lit("all")))


def separation(spark, sf_dir):
    return Q.separation(_graded(spark, sf_dir))


def transcripts(spark, sf_dir):
    return Q.transcripts(_graded(spark, sf_dir))


def recorded(spark, sf_dir):
    """A recorded run: the first reported value of the latest year answers every question of its company."""
    c = _cells(spark, sf_dir)
    s = Q.build_suite(c)
    looked = Q.lookup(s, Q.render_documents(c))
    replies = s.filter(F.col("category") == "answerable").groupBy("ticker").agg(F.min("ord").alias("ord"), F.min_by("answer", "ord").alias("reply"))
    both = Q.attach_replies(looked, replies, "recorded").unionByName(Q.answer_all(looked))
    return Q.model_against_stubs(Q.grade(both), "recorded")


def replies(spark, sf_dir):
    """Recorded replies attached to their questions: each company has one, for its first question; the others are answered by nothing."""
    s = Q.build_suite(_cells(spark, sf_dir))
    first = s.filter(F.col("category") == "answerable").groupBy("ticker").agg(F.min("ord").alias("ord"), F.min_by("answer", "ord").alias("reply"))
    return Q.attach_replies(s.select("ticker", "ord", "category"), first, "recorded").select("ticker", "ord", "category", "answer", "answerer")


def call_log(spark, sf_dir):
    """Events as a call log: the type is the answerer, the value its latency."""
    e = V.table(spark, sf_dir, "events")
    return Q.call_log_summary(e.select(F.col("event_type").alias("answerer"), F.col("value").alias("latency"),
                                       F.when(F.col("value") > 100, "timeout").alias("error")), 1.0)


def filings_index(spark, sf_dir):
    return R.parse_filings_index(V.filings_documents(V.company_facts(spark, sf_dir))).select(
        "ticker", "cik", "filed", "accession", "url", "dest")


def filings_short(spark, sf_dir):
    d = stage(V.filings_documents(V.company_facts(spark, sf_dir)), "indexes")
    return R.filings_shortfall(d, R.parse_filings_index(d))


def number_sets(spark, sf_dir):
    """Numbers, refusals and citations of whole documents."""
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("text"))), "|").alias("numbers"),
                    X.is_refusal(F.col("text")).alias("refusal"), F.size(X.cites(F.col("text"))).alias("n_cites"))


def document_sentences(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    s = X.sentences(F.col("text"))
    return d.select("doc_id", F.size(s).alias("n"), F.length(F.array_join(s, "")).alias("n_chars"))


QUERIES = {
    "facts_original_filing": original, "facts_original_by_year": original_by_year, "facts_tag_fallback": fallback,
    "facts_label_tags": labels, "facts_company_provenance": provenance, "facts_skipped": skipped,
    "suite_documents": documents, "suite_build": suite, "suite_numbered": numbered, "suite_stats": stats,
    "suite_audit": audit, "suite_prompts": prompts, "suite_figures": figures, "suite_terms": question_terms,
    "suite_lookup": looked_up, "suite_grades": grades, "suite_scores": scores, "suite_separation": separation,
    "suite_transcripts": transcripts, "suite_recorded": recorded, "suite_replies": replies,
    "suite_call_log": call_log, "filings_index": filings_index, "filings_shortfall": filings_short,
    "text_numbers": number_sets, "text_sentences": document_sentences,
}


def _case(col: str, values: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


FACTS = f"""facts AS (
  SELECT 'C' || printf('%09d', o_custkey) AS ticker,
         coalesce(CASE WHEN o_orderstatus = 'P' THEN {_case('o_orderpriority', V.AMENDED_TAGS)} END,
                  {_case('o_orderpriority', V.PRIORITY_TAGS)}) AS tag,
         CAST(year(o_orderdate) AS INT) AS fy, {_case('o_orderstatus', V.STATUS_FORMS)} AS form,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 10000 AS BIGINT) AS val,
         CAST(min(o_orderdate) AS DATE) AS filed, printf('%010d', min(o_orderkey)) AS accn
  FROM orders GROUP BY 1, 2, 3, 4)"""

BY_YEAR = f"""{FACTS}, by_year AS (
  SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, fy ORDER BY filed, accn) AS k
                           FROM facts WHERE form IN ('10-K', '10-K/A')) WHERE k = 1)"""

ORIGINAL = f"""{FACTS}, original AS (
  SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag ORDER BY fy DESC, filed, accn) AS k
                           FROM facts WHERE form IN ('10-K', '10-K/A')) WHERE k = 1)"""

_METRIC_LIST = "[" + ", ".join(f"'{m}'" for m in V.METRICS) + "]"
CELLS = f"""{BY_YEAR}, named AS (SELECT *, {_case('tag', O.TAG_LABELS)} AS label FROM by_year),
years AS (SELECT ticker, label, tag, count(*) AS n FROM named GROUP BY 1, 2, 3),
chosen AS (SELECT ticker, label, tag, n FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, label ORDER BY n DESC, tag) AS k FROM years) WHERE k = 1),
cells AS (SELECT n.*, list_position({_METRIC_LIST}, label) AS pos FROM named n JOIN chosen USING (ticker, label, tag)),
recent AS (SELECT ticker, ys[-2] AS a, ys[-1] AS b FROM (
  SELECT ticker, list_sort(list_distinct(list(fy))) AS ys FROM cells GROUP BY ticker) WHERE len(ys) >= 2)"""

_FMT = "format('{{:,}}', CAST(round_even(CAST(val AS DECIMAL(38,6)) / 1000000, 0) AS BIGINT))".replace("{{", "{").replace("}}", "}")
DOCS = f"""{CELLS}, shown AS (SELECT ticker, unnest([a, b]) AS fy FROM recent),
docs AS (SELECT ticker, fy, ticker || '-' || fy AS doc_id,
  concat_ws(chr(10), ticker || ' — selected financial data, fiscal ' || fy || ' (in millions of US dollars).',
    (SELECT string_agg(upper(label[1]) || label[2:] || ' for fiscal ' || c.fy || ' was ' || {_FMT} || '.', chr(10) ORDER BY pos)
     FROM cells c WHERE c.ticker = s.ticker AND c.fy = s.fy)) AS text FROM shown s)"""


def _ask(who: str, what: str, fy: str) -> str:
    return f"'What was ' || {who} || '''s ' || {what} || ' in fiscal ' || ({fy}) || '?'"


SUITE = f"""{DOCS}, cur AS (SELECT c.*, a, b FROM cells c JOIN recent USING (ticker)),
rep AS (SELECT ticker, any_value(a) AS a, any_value(b) AS b, list_sort(list_distinct(list(pos))) AS rep FROM cur GROUP BY ticker),
firsts AS (SELECT list(ticker) AS f FROM (SELECT DISTINCT ticker FROM cells ORDER BY 1 LIMIT 2)),
suite AS (
  SELECT ticker, 100 + pos AS ord, 'answerable' AS category, {_ask('ticker', 'label', 'b')} AS text, {_FMT} AS answer,
         ticker || '-' || b AS correct_source, NULL AS trap_value, tag || ', accession ' || accn AS note FROM cur WHERE fy = b
  UNION ALL SELECT ticker, 200 + p, 'unanswerable', {_ask('ticker', _METRIC_LIST + '[p]', 'b')}, NULL, NULL, NULL, 'never tagged'
    FROM rep, range(1, 6) AS r(p) WHERE NOT list_contains(rep, p)
  UNION ALL SELECT ticker, 300, 'unanswerable', {_ask('ticker', _METRIC_LIST + '[rep[1]]', 'b + 1')}, NULL, NULL, NULL, 'year after' FROM rep
  UNION ALL SELECT ticker, 400, 'unanswerable', {_ask('ticker', _METRIC_LIST + '[rep[1]]', 'a - 1')}, NULL, NULL, NULL, 'year before' FROM rep
  UNION ALL SELECT ticker, 500, 'unanswerable', {_ask('ticker', "'gross margin percentage'", 'b')}, NULL, NULL, NULL, 'derivable, not stated'
    FROM rep WHERE list_contains(rep, 1) AND list_contains(rep, 2)
  UNION ALL SELECT y.ticker, 600 + y.pos, 'trap', {_ask('y.ticker', 'y.label', 'y.b')}, {_FMT.replace('val', 'y.val')}, y.ticker || '-' || y.b,
         {_FMT.replace('val', 'x.val')}, 'adjacent year'
    FROM cur y JOIN cur x ON x.ticker = y.ticker AND x.pos = y.pos AND x.fy = y.a JOIN rep ON rep.ticker = y.ticker
    WHERE y.fy = y.b AND list_contains(rep.rep[1:2], y.pos)
  UNION ALL SELECT ticker, 700, 'unanswerable', {_ask("CASE WHEN ticker = f[1] THEN f[2] ELSE f[1] END", _METRIC_LIST + '[rep[1]]', 'b')},
         NULL, NULL, NULL, 'other registrant' FROM rep, firsts)"""

_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TERMS = (r"list_filter(regexp_extract_all(lower(regexp_replace(CASE WHEN strpos(text, '''s ') > 0 THEN substr(text, strpos(text, '''s ') + 3)"
          r" ELSE text END, '(?i)\bin fiscal\s+[0-9]{4}\b', ' ', 'g')), '[a-z&]+'), "
          f"lambda w: length(w) > 1 AND NOT list_contains({_STOP_LIST}, w))")
LOOKUP = rf"""{SUITE}, q AS (SELECT *, {_TERMS} AS terms, TRY_CAST(regexp_extract(text, '(?i)(?:fiscal|FY)\s*([0-9]{{4}})', 1) AS INT) AS year FROM suite),
sents AS (SELECT ticker, fy, doc_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), '. ')) AS s,
                 generate_subscripts(string_split(regexp_replace(text, '\s+', ' ', 'g'), '. '), 1) AS no FROM docs),
figs AS (SELECT ticker, fy, doc_id, no, lower(s) AS low, CAST(regexp_extract(s, '(?i)fiscal\s+([0-9]{{4}})', 1) AS INT) AS year,
                rtrim(regexp_extract(regexp_replace(s, '(?i)fiscal\s+[0-9]{{4}}', ''), '[0-9][0-9,]*(?:\.[0-9]+)?'), ',') AS figure FROM sents),
profile AS (SELECT ticker, max(year) AS latest FROM figs GROUP BY ticker),
firstnum AS (SELECT ticker, regexp_extract(text, '([0-9,]{{4,}})', 1) AS fn, doc_id AS fd FROM docs WHERE (ticker, fy) IN (SELECT (ticker, a) FROM recent)),
hits AS (SELECT q.ticker, q.ord, figs.doc_id, figs.figure, figs.year AS fy, q.year AS asked_year, latest,
                len(list_filter(terms, lambda t: contains(low, t))) AS overlap, figs.fy AS dfy, no
         FROM q JOIN figs USING (ticker) JOIN profile USING (ticker) WHERE contains(low, terms[-1])),
asked AS (SELECT ticker, ord, arg_max(figure, overlap * 1000000 - dfy * 100 - no) AS v, arg_max(doc_id, overlap * 1000000 - dfy * 100 - no) AS d
          FROM hits WHERE fy = asked_year GROUP BY 1, 2),
blind AS (SELECT ticker, ord, arg_max(figure, overlap * 1000000 - dfy * 100 - no) AS v, arg_max(doc_id, overlap * 1000000 - dfy * 100 - no) AS d
          FROM hits WHERE fy = latest GROUP BY 1, 2),
looked AS (SELECT q.*, asked.v AS av, asked.d AS ad, blind.v AS bv, blind.d AS bd, fn, fd FROM q
  LEFT JOIN asked USING (ticker, ord) LEFT JOIN blind USING (ticker, ord) JOIN firstnum USING (ticker))"""


def _nums(col: str) -> str:
    return (rf"list_distinct(list_transform(regexp_extract_all(regexp_replace({col}, '\[[A-Za-z0-9_\-]+\]', ' ', 'g'),"
            r" '-?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda x: replace(rtrim(x, '%'), ',', '')))")


def _refusal(col: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{p.replace(chr(39), chr(39) * 2)}')" for p in X.REFUSAL_PHRASES) + ")"


GRADED = rf"""{LOOKUP}, answered AS (
  SELECT looked.*, 'careful' AS answerer, 0 AS o, coalesce(av || ' [' || ad || ']', '{Q.NOT_STATED}') AS reply FROM looked
  UNION ALL SELECT looked.*, 'eager', 1, coalesce(av || ' [' || ad || ']', fn || ' [' || fd || ']', '0 [A]') FROM looked
  UNION ALL SELECT looked.*, 'year-blind', 2, coalesce(bv || ' [' || bd || ']', '{Q.NOT_STATED_SHORT}') FROM looked
  UNION ALL SELECT looked.*, 'over-refuser', 3, '{Q.OVER_REFUSAL}' FROM looked
  UNION ALL SELECT looked.*, 'uncited', 4, coalesce(av, '{Q.NOT_STATED_SHORT}') FROM looked),
srcnum AS (SELECT ticker, list_distinct(flatten(list({_nums('text')}))) AS sn FROM docs GROUP BY ticker),
base AS (SELECT answered.*, sn, {_nums('reply')} AS nums, {_refusal('reply')} AS refused,
  list_sort(list_distinct(regexp_extract_all(reply, '\[([A-Za-z0-9_\-]+)\]', 1))) AS cited FROM answered JOIN srcnum USING (ticker)),
marks AS (SELECT *, coalesce(list_contains(nums, replace(answer, ',', '')), false) AS correct_value,
  coalesce(list_contains(nums, replace(trap_value, ',', '')), false) AS has_trap, category IN ('answerable', 'trap') AS stated,
  list_sort(list_filter(nums, lambda x: NOT list_contains(sn, x))) AS made_up FROM base),
graded AS (SELECT *, has_trap AND NOT correct_value AS took_trap,
  CASE WHEN stated THEN correct_value AND NOT refused ELSE refused AND len(nums) = 0 END AS ok,
  correct_source IS NULL OR list_contains(cited, correct_source) AS citation_correct FROM marks),
final AS (SELECT *, CASE WHEN stated AND refused AND NOT correct_value THEN 'refused an answerable question'
  WHEN stated AND took_trap THEN 'took the trap value' WHEN NOT stated AND len(nums) > 0 AND NOT refused THEN 'answered an unanswerable question'
  WHEN ok THEN '' WHEN stated THEN 'wrong or missing value' ELSE 'did not refuse cleanly' END AS failure FROM graded)"""

_RATES = """count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (took_trap) AS traps_taken,
  count(*) FILTER (len(made_up) > 0) AS fabrications, round(count(*) FILTER (ok) / count(*), 4) AS accuracy,
  round(count(*) FILTER (len(made_up) > 0) / count(*), 4) AS fabrication_rate,
  round(count(*) FILTER (citation_correct) / count(*), 4) AS citation_accuracy"""

ORACLE = {
    "facts_original_filing": f"WITH {ORIGINAL} SELECT ticker, tag, fy, form, val, filed, accn FROM original",
    "facts_original_by_year": f"WITH {BY_YEAR} SELECT ticker, tag, fy, form, val, filed, accn FROM by_year",
    "facts_tag_fallback": f"""WITH {ORIGINAL}, p AS (SELECT * FROM (VALUES {', '.join(
        f"('{f}', '{t}', {k})" for f, tags in O.FIELD_TAGS.items() for k, t in enumerate(tags))}) AS v(field, tag, k))
SELECT ticker, field, tag, fy, val FROM (SELECT *, row_number() OVER (PARTITION BY ticker, field ORDER BY k) AS r
FROM original JOIN p USING (tag)) WHERE r = 1""",
    "facts_label_tags": f"WITH {CELLS} SELECT ticker, label, tag, n AS n_years FROM chosen",
    "facts_company_provenance": f"""WITH {CELLS}, r AS (SELECT ticker, list_distinct(list(label)) AS ls FROM cells GROUP BY 1)
SELECT ticker, a, b, array_to_string(list_filter({_METRIC_LIST}, lambda m: list_contains(ls, m)), ', ') AS reported,
  array_to_string(list_filter({_METRIC_LIST}, lambda m: NOT list_contains(ls, m)), ', ') AS absent FROM recent JOIN r USING (ticker)""",
    "facts_skipped": f"""WITH {CELLS} SELECT ticker, 'fewer than two fiscal years' AS reason FROM cells GROUP BY ticker HAVING count(DISTINCT fy) < 2""",
    "suite_documents": f"WITH {DOCS} SELECT ticker, doc_id, text FROM docs",
    "suite_build": f"WITH {SUITE} SELECT ticker, CAST(ord AS INT) AS ord, category, text, answer, correct_source, trap_value, note FROM suite",
    "suite_numbered": f"""WITH {SUITE} SELECT printf('R%03d', row_number() OVER (ORDER BY ticker, ord) - 1) AS qid, ticker, CAST(ord AS INT) AS ord, text FROM suite""",
    "suite_stats": f"WITH {SUITE} SELECT category, count(*) AS n, (SELECT count(DISTINCT doc_id) FROM docs) AS n_sources FROM suite GROUP BY 1",
    "suite_audit": f"""WITH {SUITE}, t AS (SELECT ticker, string_agg(text, chr(10)) AS shown FROM docs GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (category IN ('answerable', 'trap') AND NOT coalesce(contains(shown, answer), false)) AS answer_not_shown,
  count(*) FILTER (category NOT IN ('answerable', 'trap') AND answer IS NOT NULL) AS answer_to_unanswerable,
  count(*) FILTER (trap_value IS NOT NULL AND NOT contains(shown, trap_value)) AS trap_not_shown FROM suite JOIN t USING (ticker)""",
    "suite_prompts": f"""WITH {SUITE}, p AS (SELECT ticker, string_agg('--- DOCUMENT ' || doc_id || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY fy) AS d
  FROM docs GROUP BY 1) SELECT ticker, CAST(ord AS INT) AS ord, d || chr(10) || chr(10) || '--- QUESTION ---' || chr(10) || text AS prompt FROM suite JOIN p USING (ticker)""",
    "suite_terms": f"WITH {LOOKUP} SELECT ticker, CAST(ord AS INT) AS ord, array_to_string(terms, ' ') AS terms, year FROM q",
    "suite_lookup": f"WITH {LOOKUP} SELECT ticker, CAST(ord AS INT) AS ord, av AS asked, ad AS asked_doc, bv AS blind, fn AS first_number FROM looked",
    "suite_grades": f"""WITH {GRADED} SELECT answerer, ticker, CAST(ord AS INT) AS ord, reply AS answer, ok, correct_value, took_trap, refused, failure, citation_correct,
  array_to_string(made_up, ',') AS fabricated, array_to_string(cited, ',') AS cited FROM final""",
    "suite_scores": f"""WITH {GRADED} SELECT answerer, category, {_RATES} FROM final GROUP BY 1, 2
UNION ALL SELECT answerer, 'all', {_RATES} FROM final GROUP BY 1""",
    "suite_separation": f"""WITH {GRADED}, acc AS (SELECT answerer, o, round(avg(CAST(ok AS INT)), 4) AS a FROM final GROUP BY 1, 2)
SELECT (SELECT answerer FROM acc ORDER BY a DESC, o LIMIT 1) AS best, (SELECT answerer FROM acc ORDER BY a, o LIMIT 1) AS worst,
  round(max(a) - min(a), 4) AS spread FROM acc""",
    "suite_transcripts": f"WITH {GRADED} SELECT answerer, ticker, CAST(ord AS INT) AS ord, text AS question, reply AS answer, category, ok, failure FROM final",
    "suite_figures": rf"""WITH {LOOKUP} SELECT ticker, doc_id, CASE WHEN right(low, 1) = '.' THEN low ELSE low || '.' END AS low, year, figure FROM figs WHERE figure <> ''""",
    "suite_call_log": """SELECT event_type AS answerer, count(*) AS calls, count(*) FILTER (value > 100) AS failed,
  list_sort(list(value))[count(*) // 2 + 1] AS median_latency FROM events GROUP BY 1""",
    "filings_index": f"""WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, accn DESC) AS r FROM facts WHERE form = '10-K')
SELECT ticker, lpad(regexp_replace(ticker, '^C0*', ''), 10, '0') AS cik, CAST(filed AS VARCHAR) AS filed, accn || '-1' AS accession,
  'https://www.sec.gov/Archives/edgar/data/' || regexp_replace(ticker, '^C0*', '') || '/' || accn || '1/' || accn || '.htm' AS url,
  lower(ticker) || '/10-K-' || filed || '.htm' AS dest FROM k WHERE r <= 2""",
    "filings_shortfall": f"""WITH {FACTS} SELECT ticker, count(*) FILTER (form = '10-K') AS found, 2 AS needed FROM facts GROUP BY 1 HAVING count(*) FILTER (form = '10-K') < 2""",
    "text_numbers": rf"""SELECT doc_id, array_to_string(list_sort({_nums('text')}), '|') AS numbers, {_refusal('text')} AS refusal,
  CAST(len(list_distinct(regexp_extract_all(text, '\[([A-Za-z0-9_\-]+)\]', 1))) AS INT) AS n_cites FROM documents""",
    "text_sentences": r"""WITH f AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\. ', '.' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, CAST(len(list_filter(s, lambda x: x <> '')) AS INT) AS n, CAST(length(array_to_string(s, '')) AS INT) AS n_chars FROM f""",
}
ORACLE["suite_replies"] = f"""SELECT ticker, ord, category, CASE WHEN ord = min(ord) FILTER (category = 'answerable') OVER (PARTITION BY ticker) THEN answer ELSE '' END AS answer,
  'recorded' AS answerer FROM ({ORACLE['suite_build']})"""
