"""Lineage queries, and checks of cached files."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.catalogue.filings import FACTS, ORIGINAL
from evidentia.functions import text as X
from evidentia.operators import facts as O
from evidentia.operators import lineage as K
from evidentia.operators import manifest as M
from evidentia.plans import company_lineage as C
from evidentia.session import stage
from evidentia.sources import readers as R
from evidentia.sources import tables as V

BEFORE, FIGURE = r"\s", r"[0-9][0-9,]*(?:\.[0-9]+)?"


def _concepts(spark, sf_dir):
    """Concept documents, staged: facts and spans are both read from them."""
    return stage(V.concept_documents(V.company_facts(spark, sf_dir)), "concepts", "ticker")


def _metrics(spark, sf_dir):
    docs = _concepts(spark, sf_dir)
    return C.derive_metrics(C.company_row(C.located_fields(docs))), docs


def extracted(spark, sf_dir):
    return K.extract(V.table(spark, sf_dir, "documents"), BEFORE, FIGURE).select("doc_id", "raw", "start", "end", "doc_sha")


def extracted_pattern(spark, sf_dir):
    out = K.extract_pattern(V.table(spark, sf_dir, "documents"), rf"{BEFORE}({FIGURE})")
    return out.select("doc_id", "raw", "start", "end")


def concepts(spark, sf_dir):
    return R.parse_concepts(_concepts(spark, sf_dir)).select("ticker", "tag", "unit", F.col("val").cast("double").alias("val"), "start", "end", "fy", "form", "filed", "accn")


def spans(spark, sf_dir):
    t = C.located_fields(_concepts(spark, sf_dir))
    s = F.get(F.col("tracked.spans"), F.lit(0))
    return t.select("ticker", "field", "tag", F.col("tracked.value").alias("value"), s["start"].alias("start"), s["end"].alias("end"),
                    s["doc_sha"].alias("doc_sha"), F.col("tracked.note").alias("note"))


def cards(spark, sf_dir):
    """Cards of the metrics, each with the depth of its derivation."""
    docs, key = _concepts(spark, sf_dir), ["ticker", "metric"]
    row = stage(C.company_row(C.located_fields(docs)), "companies", "ticker")
    graphs = K.derivation_graphs(row, ["ticker"], C.metric_definitions())
    return K.metric_card(stage(C.derive_metrics(row), "metrics", "ticker"), docs, key, stats=K.graph_stats(*graphs, key))


def evidence(spark, sf_dir):
    m, docs = _metrics(spark, sf_dir)
    return K.evidence(m, docs, ["ticker", "metric"]).select("ticker", "metric", F.col("span_no").cast("int").alias("span_no"), "doc_id", "evidence")


def _companies(spark, sf_dir):
    return stage(C.company_row(C.located_fields(_concepts(spark, sf_dir))), "companies", "ticker")


def shapes() -> dict[str, K.Tracked]:
    """The metrics, and one derivation for each of the other operations."""
    revenue, cost = K.Tracked.leaf("revenue"), K.Tracked.leaf("cost")
    return {**C.metric_definitions(), "total": revenue + cost, "twice": revenue + revenue, "scaled": 1.5 * revenue, "loss": -(revenue - cost),
            "root": revenue.apply(F.sqrt, "root")}


def _graphs(spark, sf_dir):
    return K.derivation_graphs(_companies(spark, sf_dir), ["ticker"], shapes())


def arithmetic(spark, sf_dir):
    """Value, operation and sources of every shape."""
    made = F.array(*[F.struct(F.lit(n).alias("metric"), t.column().alias("t")) for n, t in shapes().items()])
    rows = _companies(spark, sf_dir).select("ticker", F.explode(made).alias("m")).filter("m.t IS NOT NULL")
    return rows.select("ticker", "m.metric", F.round("m.t.value", 4).alias("value"), F.col("m.t.op").alias("op"), F.size("m.t.spans").alias("n_spans"))


def lifted(spark, sf_dir):
    """A function of one's own, in Arrow batches, lifted over tracked values: their spans stay."""
    import numpy as np

    log = F.pandas_udf(lambda x: np.log10(x), "double")
    t = K.Tracked.leaf("revenue").apply(log, "log10").column()
    rows = _companies(spark, sf_dir).select("ticker", t.alias("t")).filter("t IS NOT NULL")
    return rows.select("ticker", F.round("t.value", 6).alias("value"), F.col("t.op").alias("op"), F.size("t.spans").alias("n_spans"))


def graph_stats(spark, sf_dir):
    return K.graph_stats(*_graphs(spark, sf_dir), ["ticker", "metric"])


def explained(spark, sf_dir):
    e = K.explain(*_graphs(spark, sf_dir), ["ticker", "metric"])
    return e.select("ticker", "metric", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "depth", "op",
                    F.round("value", 6).alias("value"), "note", F.coalesce(F.size("leaf_spans"), F.lit(-1)).alias("leaf_spans"))


def dot(spark, sf_dir):
    """Digraph text of the gross margin, its lines in order."""
    nodes, edges, _ = K.derivation_graph(_companies(spark, sf_dir), ["ticker"], C.metric_definitions()["gross_margin"])
    lines = K.to_dot(nodes, edges, ["ticker"]).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("section", "place", "line"))).alias("l"))
    return lines.select("ticker", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("dot"))


def verified(spark, sf_dir):
    m, docs = _metrics(spark, sf_dir)
    out = K.verify_against(C.headline(m), docs, ["ticker", "metric"])
    return out.select("ticker", "metric", "n_spans", "n_checked", "n_problems", "ok")


def verified_elsewhere(spark, sf_dir):
    """Verification where revenue documents are missing and cost documents have grown a line."""
    m, docs = _metrics(spark, sf_dir)
    cost = F.col("tag").isin(*O.FIELD_TAGS["cost"])
    now = docs.filter(~F.col("tag").isin("Revenues")).withColumn("text", F.when(cost, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return K.verify_against(C.headline(m), now, ["ticker", "metric"]).select(
        "ticker", "metric", "n_spans", "n_checked", "n_problems", "first_issue", "ok")


def problems(spark, sf_dir):
    """The spans behind ``verified_elsewhere``'s verdicts, one row each."""
    m, docs = _metrics(spark, sf_dir)
    cost = F.col("tag").isin(*O.FIELD_TAGS["cost"])
    now = docs.filter(~F.col("tag").isin("Revenues")).withColumn("text", F.when(cost, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    out = K.span_problems(C.headline(m), now, ["ticker", "metric"])
    return out.select("ticker", "metric", F.col("span_no").cast("int").alias("span_no"), "doc_id", "issue", "recorded_sha", "current_sha", "actual")


def tampered(spark, sf_dir):
    m, docs = _metrics(spark, sf_dir)
    return K.tamper_probe(C.headline(m), docs, ["ticker", "metric"]).select("ticker", "metric", "n_spans", "n_problems", "ok")


def _files(spark, sf_dir):
    """(manifest, scan): what was recorded for each document, and what is there now."""
    d = V.table(spark, sf_dir, "documents")
    dest = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("dest")
    url = F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))
    manifest = d.select(dest, F.sha2("text", 256).alias("sha256"), X.fingerprint(url, F.lit(None).cast("string")).alias("request_fingerprint"))
    now = F.when(F.col("lang") == "fr", F.lower("text")).otherwise(F.col("text"))
    scan = d.filter(F.col("lang") != "de").select(dest, F.sha2(now, 256).alias("sha256"))
    wanted = d.select(dest, X.fingerprint(url, F.when(F.col("lang") == "es", F.col("source"))).alias("request_fingerprint"))
    return manifest, scan, wanted


def manifest_verify(spark, sf_dir):
    manifest, scan, _ = _files(spark, sf_dir)
    return M.verify_manifest(manifest, scan)


def manifest_refresh(spark, sf_dir):
    manifest, scan, wanted = _files(spark, sf_dir)
    return M.plan_refresh(wanted, manifest, scan)


def manifest_require(spark, sf_dir):
    _, scan, wanted = _files(spark, sf_dir)
    return M.require(wanted, scan)


def manifest_upsert(spark, sf_dir):
    manifest, scan, wanted = _files(spark, sf_dir)
    fresh = scan.join(wanted, "dest")
    return M.upsert_manifest(manifest, fresh.select(*manifest.columns))


QUERIES = {
    "lineage_extract": extracted, "lineage_extract_pattern": extracted_pattern, "lineage_concepts": concepts,
    "lineage_spans": spans, "lineage_metric_cards": cards, "lineage_evidence": evidence, "lineage_graph_stats": graph_stats,
    "lineage_explain": explained, "lineage_arithmetic": arithmetic, "lineage_lifted": lifted, "lineage_dot": dot, "lineage_verify": verified, "lineage_verify_changed": verified_elsewhere,
    "lineage_tamper": tampered, "lineage_problems": problems, "manifest_verify": manifest_verify, "manifest_refresh": manifest_refresh,
    "manifest_require": manifest_require, "manifest_upsert": manifest_upsert,
}

_EXTRACT = rf"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, raw, CAST(at0 AS INT) AS start, CAST(at0 + length(raw) AS INT) AS "end", substr(sha256(text), 1, 16) AS doc_sha
FROM (SELECT doc_id, text, regexp_extract(text, '\s({FIGURE})', 1) AS raw, strpos(text, regexp_extract(text, '\s{FIGURE}')) AS at0
      FROM documents WHERE regexp_matches(text, '\s[0-9]'))"""

_FACT = """'{"start":"' || fy || '-01-01","end":"' || fy || '-12-31","val":' || val || ',"accn":"' || accn || '","fy":' || fy
  || ',"fp":"FY","form":"' || form || '","filed":"' || filed || '"}'"""

DOCS = f"""{ORIGINAL}, concept AS (SELECT ticker, tag, ticker || ':' || tag AS doc_id,
  '{{"tag":"' || tag || '","units":{{"USD":[' || string_agg({_FACT}, ',' ORDER BY fy, form) || ']}}}}' AS text FROM facts GROUP BY ticker, tag),
pref AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{t}', {k})" for f, tags in O.FIELD_TAGS.items() for k, t in enumerate(tags))}) AS v(field, tag, k)),
fields AS (SELECT * EXCLUDE (k, r) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, field ORDER BY k) AS r
  FROM original JOIN pref USING (tag)) WHERE r = 1),
located AS (SELECT f.*, c.doc_id, c.text, strpos(c.text, {_FACT}) - 1 + strpos({_FACT}, '"val":') + 5 AS at0,
  tag || ' ' || fy || ' ' || form AS note FROM fields f JOIN concept c USING (ticker, tag)),
company AS (SELECT ticker, max(val) FILTER (field = 'revenue') AS revenue, max(val) FILTER (field = 'cost') AS cost, max(val) FILTER (field = 'rnd') AS rnd,
  max(doc_id) FILTER (field = 'revenue') AS rd, max(doc_id) FILTER (field = 'cost') AS cd, max(doc_id) FILTER (field = 'rnd') AS nd,
  max(note) FILTER (field = 'revenue') AS rn, max(note) FILTER (field = 'cost') AS cn FROM located GROUP BY ticker),
metric AS (
  SELECT ticker, 'revenue' AS metric, CAST(revenue AS DOUBLE) AS value, 'extract' AS op, [rd] AS ds, [revenue] AS vs FROM company WHERE revenue IS NOT NULL
  UNION ALL SELECT ticker, 'gross_profit', CAST(revenue - cost AS DOUBLE), 'sub', [rd, cd], [revenue, cost] FROM company WHERE revenue IS NOT NULL AND cost IS NOT NULL
  UNION ALL SELECT ticker, 'gross_margin', CAST(revenue - cost AS DOUBLE) / revenue, 'div', [rd, cd], [revenue, cost] FROM company WHERE revenue IS NOT NULL AND cost IS NOT NULL
  UNION ALL SELECT ticker, 'rnd_intensity', CAST(rnd AS DOUBLE) / revenue, 'div', [nd, rd], [rnd, revenue] FROM company WHERE revenue IS NOT NULL AND rnd IS NOT NULL),
head AS (SELECT * FROM metric WHERE metric = 'gross_margin' UNION ALL
  SELECT * FROM metric WHERE metric = 'revenue' AND ticker NOT IN (SELECT ticker FROM metric WHERE metric = 'gross_margin'))"""

_FILES = """d AS (SELECT lang || '/' || doc_id || '.txt' AS dest, lang, sha256(text) AS sha, sha256(CASE WHEN lang = 'fr' THEN lower(text) ELSE text END) AS now,
  substr(sha256('{"body": null, "url": "https://example.com/' || doc_id || '"}'), 1, 16) AS fp FROM documents)"""

_ISSUES = """spans AS (SELECT ticker, metric, i, ds[i + 1] AS doc_id FROM head, range(0, 2) AS r(i) WHERE i < len(ds)),
seen AS (SELECT *, CASE WHEN doc_id LIKE '%:Revenues' THEN 'source not supplied'
  WHEN doc_id LIKE '%:Cost%' THEN 'document has changed' END AS issue FROM spans)"""

# Derivations as lists: a node's operation, value and note by number, 0 the derived value; its inputs by place.
_NODES = """c AS (SELECT *, CAST(revenue AS DOUBLE) AS r, CAST(cost AS DOUBLE) AS k, CAST(rnd AS DOUBLE) AS d, (SELECT max(note) FROM located l WHERE l.ticker = company.ticker AND field = 'rnd') AS dn
  FROM company),
n AS (SELECT ticker, unnest([
    {'metric': 'revenue', 'node': 0, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'gross_profit', 'node': 0, 'op': 'sub', 'value': r - k, 'note': '', 'doc': ''},
    {'metric': 'gross_profit', 'node': 1, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'gross_profit', 'node': 2, 'op': 'extract', 'value': k, 'note': cn, 'doc': cd},
    {'metric': 'gross_margin', 'node': 0, 'op': 'div', 'value': (r - k) / r, 'note': '', 'doc': ''}, {'metric': 'gross_margin', 'node': 1, 'op': 'sub', 'value': r - k, 'note': '', 'doc': ''},
    {'metric': 'gross_margin', 'node': 2, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'gross_margin', 'node': 3, 'op': 'extract', 'value': k, 'note': cn, 'doc': cd},
    {'metric': 'rnd_intensity', 'node': 0, 'op': 'div', 'value': d / r, 'note': '', 'doc': ''}, {'metric': 'rnd_intensity', 'node': 1, 'op': 'extract', 'value': d, 'note': dn, 'doc': nd},
    {'metric': 'rnd_intensity', 'node': 2, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'total', 'node': 0, 'op': 'add', 'value': r + k, 'note': '', 'doc': ''},
    {'metric': 'total', 'node': 1, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'total', 'node': 2, 'op': 'extract', 'value': k, 'note': cn, 'doc': cd},
    {'metric': 'twice', 'node': 0, 'op': 'add', 'value': r + r, 'note': '', 'doc': ''}, {'metric': 'twice', 'node': 1, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd},
    {'metric': 'scaled', 'node': 0, 'op': 'mul', 'value': r * 1.5, 'note': '', 'doc': ''}, {'metric': 'scaled', 'node': 1, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd},
    {'metric': 'loss', 'node': 0, 'op': 'neg', 'value': k - r, 'note': '', 'doc': ''}, {'metric': 'loss', 'node': 1, 'op': 'sub', 'value': r - k, 'note': '', 'doc': ''},
    {'metric': 'loss', 'node': 2, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}, {'metric': 'loss', 'node': 3, 'op': 'extract', 'value': k, 'note': cn, 'doc': cd},
    {'metric': 'root', 'node': 0, 'op': 'root', 'value': sqrt(r), 'note': '', 'doc': ''}, {'metric': 'root', 'node': 1, 'op': 'extract', 'value': r, 'note': rn, 'doc': rd}], recursive := true) FROM c),
whole AS (SELECT ticker, metric FROM n WHERE node = 0 AND value IS NOT NULL),
e(metric, dst, src, pos) AS (VALUES ('gross_profit', 0, 1, 0), ('gross_profit', 0, 2, 1), ('gross_margin', 0, 1, 0), ('gross_margin', 0, 2, 1), ('gross_margin', 1, 2, 0), ('gross_margin', 1, 3, 1),
  ('rnd_intensity', 0, 1, 0), ('rnd_intensity', 0, 2, 1), ('total', 0, 1, 0), ('total', 0, 2, 1), ('twice', 0, 1, 0), ('twice', 0, 1, 1), ('scaled', 0, 1, 0),
  ('loss', 0, 1, 0), ('loss', 1, 2, 0), ('loss', 1, 3, 1), ('root', 0, 1, 0)),
walk AS (SELECT metric, 0 AS node, 0 AS depth, '' AS path FROM (SELECT DISTINCT metric FROM n)
  UNION ALL SELECT w.metric, e.src, depth + 1, CASE WHEN path = '' THEN '' ELSE path || '.' END || e.pos FROM walk w JOIN e ON e.metric = w.metric AND e.dst = w.node)"""
# As a digraph: node names hash operation, number, place of the digits and value as Spark writes a double.
_DOT = """leafs AS (SELECT ticker, field, doc_id || ':' || at0 || ':' || (at0 + length(CAST(val AS VARCHAR))) AS place FROM located),
g AS (SELECT ticker, r, k, rp.place AS p, kp.place AS q FROM c JOIN leafs rp USING (ticker) JOIN leafs kp USING (ticker)
  WHERE rp.field = 'revenue' AND kp.field = 'cost')"""

ORACLE = {
    "lineage_extract": _EXTRACT,
    "lineage_extract_pattern": f"SELECT doc_id, raw, start, \"end\" FROM ({_EXTRACT})",
    "lineage_concepts": f"""WITH {FACTS} SELECT ticker, tag, 'USD' AS unit, CAST(val AS DOUBLE) AS val, fy || '-01-01' AS start, fy || '-12-31' AS "end", fy, form,
  CAST(filed AS VARCHAR) AS filed, accn FROM facts""",
    "lineage_spans": f"""WITH {DOCS} SELECT ticker, field, tag, CAST(val AS DOUBLE) AS value, CAST(at0 AS INT) AS start,
  CAST(at0 + length(CAST(val AS VARCHAR)) AS INT) AS "end", substr(sha256(text), 1, 16) AS doc_sha, note FROM located""",
    "lineage_metric_cards": f"""WITH {DOCS} SELECT ticker, metric, round(value, 6) + 0.0 AS value, op, len(ds) AS n_spans,
  array_to_string(list_sort(ds), ',') AS documents, array_to_string(vs, ',') AS evidence,
  CASE op WHEN 'extract' THEN 0 WHEN 'sub' THEN 1 ELSE CASE metric WHEN 'gross_margin' THEN 2 ELSE 1 END END AS depth FROM metric""",
    "lineage_evidence": f"""WITH {DOCS} SELECT ticker, metric, CAST(i AS INT) AS span_no, ds[i + 1] AS doc_id, CAST(vs[i + 1] AS VARCHAR) AS evidence
FROM metric, range(0, 2) AS r(i) WHERE i < len(ds)""",
    "lineage_graph_stats": f"""WITH RECURSIVE {DOCS}, {_NODES},
d AS (SELECT metric, max(depth) AS depth FROM walk GROUP BY 1),
counts AS (SELECT n.ticker, n.metric, count(*) AS n_nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.metric = n.metric AND e.dst = n.node)) AS n_leaves,
  string_agg(DISTINCT op, ',' ORDER BY op) AS ops FROM n JOIN whole USING (ticker, metric) GROUP BY 1, 2)
SELECT ticker, metric, n_nodes, (SELECT count(*) FROM e WHERE e.metric = counts.metric) AS n_edges, CAST(depth AS INT) AS depth, n_leaves, ops FROM counts JOIN d USING (metric)""",
    "lineage_explain": f"""WITH RECURSIVE {DOCS}, {_NODES}
SELECT ticker, metric, path, CAST(depth AS INT) AS depth, op, round(value, 6) + 0.0 AS value, note, CASE WHEN op = 'extract' THEN 1 ELSE -1 END AS leaf_spans
FROM walk JOIN n USING (metric, node) JOIN whole USING (ticker, metric)""",
    "lineage_arithmetic": f"""WITH RECURSIVE {DOCS}, {_NODES}
SELECT ticker, metric, round(value, 4) + 0.0 AS value, op,
  CAST((SELECT count(DISTINCT m.doc) FROM n m WHERE m.ticker = n.ticker AND m.metric = n.metric AND m.doc <> '') AS INT) AS n_spans FROM n JOIN whole USING (ticker, metric) WHERE node = 0""",
    "lineage_lifted": f"WITH {DOCS} SELECT ticker, round(log10(revenue), 6) + 0.0 AS value, 'log10' AS op, 1 AS n_spans FROM company WHERE revenue IS NOT NULL",
    "lineage_dot": f"""WITH RECURSIVE {DOCS}, {_NODES}, {_DOT}, ids AS (SELECT *,
    substr(sha256('div|0|' || p || ',' || q || '|' || printf('%.6f', (r - k) / r)), 1, 16) AS n0, substr(sha256('sub|1|' || p || ',' || q || '|' || printf('%.6f', r - k)), 1, 16) AS n1,
    substr(sha256('extract|2|' || p || '|' || printf('%.6f', r)), 1, 16) AS n2, substr(sha256('extract|3|' || q || '|' || printf('%.6f', k)), 1, 16) AS n3 FROM g WHERE r IS NOT NULL AND k IS NOT NULL)
SELECT ticker, array_to_string(['digraph lineage {{', '  rankdir=BT;', '  node [shape=box];',
  '  n' || n0 || ' [label="div\\n' || printf('%.6f', (r - k) / r) || '"];', '  n' || n1 || ' [label="sub\\n' || printf('%.6f', r - k) || '"];',
  '  n' || n2 || ' [label="extract\\n' || printf('%.6f', r) || '"];', '  n' || n3 || ' [label="extract\\n' || printf('%.6f', k) || '"];',
  '  n' || n1 || ' -> n' || n0 || ';', '  n' || n2 || ' -> n' || n0 || ';', '  n' || n2 || ' -> n' || n1 || ';', '  n' || n3 || ' -> n' || n1 || ';', '}}'], chr(10)) AS dot FROM ids""",
    "lineage_verify": f"""WITH {DOCS} SELECT ticker, metric, len(ds) AS n_spans, len(ds) AS n_checked, 0 AS n_problems, true AS ok FROM head""",
    "lineage_verify_changed": f"""WITH {DOCS}, {_ISSUES} SELECT ticker, metric, count(*) AS n_spans,
  count(*) FILTER (issue IS NULL OR issue <> 'source not supplied') AS n_checked, count(issue) AS n_problems, arg_min(issue, i) FILTER (issue IS NOT NULL) AS first_issue,
  count(issue) = 0 AS ok FROM seen GROUP BY 1, 2""",
    "lineage_problems": f"""WITH {DOCS}, s AS (SELECT ticker, metric, i, ds[i + 1] AS doc_id, CAST(vs[i + 1] AS VARCHAR) AS digits FROM head, range(0, 2) AS r(i) WHERE i < len(ds))
SELECT ticker, metric, CAST(i AS INT) AS span_no, doc_id, CASE WHEN doc_id LIKE '%:Revenues' THEN 'source not supplied' ELSE 'document has changed' END AS issue,
  substr(sha256(text), 1, 16) AS recorded_sha, CASE WHEN doc_id LIKE '%:Cost%' THEN substr(sha256(text || chr(10)), 1, 16) END AS current_sha,
  CASE WHEN doc_id LIKE '%:Cost%' THEN digits END AS actual
FROM s JOIN (SELECT doc_id, text FROM concept) USING (doc_id) WHERE doc_id LIKE '%:Revenues' OR doc_id LIKE '%:Cost%'""",
    "lineage_tamper": f"""WITH {DOCS}, first AS (SELECT h.ticker, metric, ds, l.doc_id AS hit, text,
    substr(text, 1, at0) || CASE WHEN substr(text, at0 + 1, 1) = '9' THEN '8' ELSE '9' END || substr(text, at0 + 2) AS altered
  FROM head h JOIN located l ON l.doc_id = h.ds[1] AND l.ticker = h.ticker)
SELECT ticker, metric, len(ds) AS n_spans, CASE WHEN sha256(text) <> sha256(altered) THEN len(list_filter(ds, lambda x: x = hit)) ELSE 0 END AS n_problems,
  sha256(text) = sha256(altered) AS ok FROM first""",
    "manifest_verify": f"""WITH {_FILES} SELECT dest, CASE WHEN lang = 'de' THEN 'recorded in manifest but missing on disk'
  ELSE 'on-disk bytes do not match recorded sha256' END AS issue FROM d WHERE lang = 'de' OR sha <> now""",
    "manifest_refresh": f"WITH {_FILES} SELECT dest, lang IN ('de', 'es') OR sha <> now AS needs_fetch FROM d",
    "manifest_require": f"WITH {_FILES} SELECT dest FROM d WHERE lang = 'de'",
    "manifest_upsert": f"""WITH {_FILES}
SELECT dest, CASE WHEN d.lang = 'de' THEN sha ELSE now END AS sha256, CASE WHEN d.lang = 'es' THEN
  substr(sha256('{{"body": "' || source || '", "url": "https://example.com/' || doc_id || '"}}'), 1, 16) ELSE fp END AS request_fingerprint
FROM d JOIN documents ON dest = documents.lang || '/' || doc_id || '.txt'""",
}
