"""Message, context, citation and preference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import chat as C
from evidentia.operators import citations as R
from evidentia.operators import preference as P
from evidentia.sources import tables as V

RULES = C.RoutingRules(
    group_names=["room 1", "room 3"], group_name_keywords=["5"], group_prefixes=["bot", "@helper"], group_keywords=["tion"],
    single_prefixes=["bot", "@helper"], shared_groups=["room 3"], trigger_by_self=False, bot_name="helper")
WORDS = ["tion", "ion", "the", "euxan", "que", "onth"]
ROLES = ["assistant", "user", "system", "translator", "analyst", "engineer", "smallest gear", "old ring"]
BUDGET = 1000
#: Entries of the long word list.
MANY = 10000


def _messages(spark, sf_dir):
    return V.chat_messages(spark, sf_dir)


def _turns(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations")


def routed(spark, sf_dir):
    return C.route_messages(_messages(spark, sf_dir), RULES).select("msg_id", "content", "session_id", "is_group")


def prefixes(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("msg_id", C.check_prefix(F.col("content"), ["bot", "@helper", "b"]).alias("prefix"),
                    C.check_contain(F.col("content"), ["tion", "que"]).alias("hit"))


def mentions(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("msg_id", C.strip_mention(F.col("content"), "helper", "bot").alias("content"))


def hours(spark, sf_dir):
    return C.service_hours(_messages(spark, sf_dir), "08:30", "17:45").select("msg_id")


def sessions(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.groupBy(C.session_key(RULES).alias("session_id")).agg(F.count(F.lit(1)).alias("n"))


def keyword(spark, sf_dir):
    """Every part name is a keyword; segments and event types ask for them."""
    part = V.table(spark, sf_dir, "part")
    replies = part.groupBy(F.col("p_name").alias("keyword")).agg(
        F.min(F.concat(F.lit("https://example.com/"), F.regexp_replace("p_name", " ", "-"), F.when(F.contains("p_name", F.lit("red")), ".png").otherwise(".html"))).alias("reply"))
    asked = part.select(F.col("p_partkey").alias("msg_id"), F.concat(F.lit(" "), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_type")), F.lit("\n")).alias("content"))
    return C.keyword_reply(asked, replies).select("msg_id", "reply", "reply_type")


def app_lookup(spark, sf_dir):
    m = _messages(spark, sf_dir)
    apps = V.table(spark, sf_dir, "nation").groupBy(F.format_string("room %d", F.col("n_nationkey") % 4).alias("name")).agg(F.max("n_name").alias("app"))
    default = V.table(spark, sf_dir, "region").agg(F.max("r_name").alias("app")).select(F.lit(C.ALL_GROUP).alias("name"), "app")
    return C.lookup_with_default(m, apps.unionByName(default)).groupBy("group_name", "app").agg(F.count(F.lit(1)).alias("n"))


def closest(spark, sf_dir):
    names = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return C.closest_role(names, ROLES).groupBy("name", "role").agg(F.count(F.lit(1)).alias("n"))


def banned(spark, sf_dir):
    return C.find_banned(_messages(spark, sf_dir), WORDS, ["msg_id"])


def banned_first(spark, sf_dir):
    return C.first_banned(C.find_banned(_messages(spark, sf_dir), WORDS, ["msg_id"]), ["msg_id"])


def banned_mask(spark, sf_dir):
    return C.mask_banned(_messages(spark, sf_dir), WORDS).select("msg_id", "masked")


def banned_documents(spark, sf_dir):
    """Word hits over the whole documents."""
    d = V.table(spark, sf_dir, "documents")
    return C.find_banned(d, ["wingthth", "token", "http"], ["doc_id"], "text").groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def frequent_words(spark, sf_dir, n: int = MANY) -> list[str]:
    """The word list of the long-list queries: the ``n`` most frequent words of six letters or more; the list is a parameter of ``n`` entries."""
    d = V.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w"))
    top = d.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(n)
    # cut to n words by one task; collected as it is, each task of the count would send n words to the driver
    return [r["w"] for r in top.repartition(1).sortWithinPartitions(F.desc("n"), "w").collect()]


def banned_many(spark, sf_dir):
    """Occurrences of ten thousand words in every message, by word."""
    found = C.find_banned(_messages(spark, sf_dir), frequent_words(spark, sf_dir), ["msg_id"])
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.count_distinct("msg_id").alias("messages"))


def banned_many_mask(spark, sf_dir):
    m = _messages(spark, sf_dir).select("msg_id", "content")
    return C.mask_banned(m, frequent_words(spark, sf_dir)).select("msg_id", "masked")


def banned_reply(spark, sf_dir):
    """What assistants said, before it is sent: texts are filtered, other kinds pass."""
    r = V.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        F.format_string("%d-%d", "conv_id", "turn").alias("msg_id"), F.when(F.col("turn") % 4 == 3, "IMAGE_URL").otherwise("TEXT").alias("reply_type"), F.col("text").alias("reply"))
    both = [C.banned_replies(r, WORDS, action).withColumn("action", F.lit(action)) for action in ("ignore", "replace")]
    return both[0].unionByName(both[1])


def banned_action(spark, sf_dir):
    m = _messages(spark, sf_dir)
    kept = C.banned_actions(m, WORDS, "ignore").select("msg_id", F.lit("ignore").alias("action"), "reply")
    return kept.unionByName(C.banned_actions(m, WORDS, "replace").select("msg_id", F.lit("replace").alias("action"), "reply"))


def chunks(spark, sf_dir):
    """Whole documents in pieces of at most 500 bytes, and in at most four of 90 bytes and a rest."""
    d = V.table(spark, sf_dir, "documents")
    cut = [C.chunk_utf8(d, ["doc_id"], "text", size, pieces).withColumn("max_split", F.lit(pieces)) for size, pieces in ((500, 0), (90, 4))]
    return cut[0].unionByName(cut[1])


def context(spark, sf_dir):
    return C.fit_context(_turns(spark, sf_dir), F.length("text"), BUDGET).select("conv_id", "turn", "role")


def context_pairs(spark, sf_dir):
    return C.fit_context_pairs(_turns(spark, sf_dir), F.length("text"), BUDGET).select("conv_id", "turn", "role")


def context_plain(spark, sf_dir):
    return C.fit_context_plain(_turns(spark, sf_dir), BUDGET).select("conv_id", "turn", "role")


def dialog(spark, sf_dir):
    return C.render_dialog(C.fit_context_plain(_turns(spark, sf_dir), BUDGET))


def tokens(spark, sf_dir):
    return C.session_tokens_by_form(_turns(spark, sf_dir), F.length("text"), list(C.TOKEN_FORMS))


def paragraphs(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", R.page_paragraphs(F.col("html")).alias("paragraphs"))


def research(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    p = p.withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1)).withColumn("title", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    return R.combine_research(p, "host", "page_id", "title", "html")


def apa(spark, sf_dir):
    return R.apa(V.papers(spark, sf_dir)).select("paper_id", "apa")


def references(spark, sf_dir):
    return R.reference_list(V.papers(spark, sf_dir))


def cited(spark, sf_dir):
    a = R.apa(V.papers(spark, sf_dir))
    one = lambda i: R.in_text_citation(F.col("apa_authors"), F.col("year"), F.lit(i))
    return R.insert_citations(a.withColumn("citations", F.array(one(1), one(2), one(3))), "paper_id").select("paper_id", "cited_text")


def pairs(spark, sf_dir):
    whole, rejected = P.require_fields(V.reply_pairs(spark, sf_dir))
    return whole.select("pair_id", F.lit(True).alias("ok")).unionByName(rejected.select("pair_id", F.lit(False).alias("ok")))


def dataset(spark, sf_dir):
    return P.preference_dataset(V.reply_pairs(spark, sf_dir), "pair_id", 0.2).select("pair_id", "chosen_text", "rejected_text", "part")


def fingerprints(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.sha16(F.col("text")).alias("sha"), X.text_slice(F.col("text"), F.lit(3), F.length("text")).alias("rest"))


QUERIES = {
    "chat_route": routed, "chat_prefix": prefixes, "chat_mention": mentions, "chat_service_hours": hours, "chat_session_key": sessions,
    "chat_keyword_reply": keyword, "chat_app_lookup": app_lookup, "chat_closest_role": closest, "banned_find": banned,
    "banned_first": banned_first, "banned_mask": banned_mask, "banned_documents": banned_documents, "banned_actions": banned_action,
    "banned_many": banned_many, "banned_many_mask": banned_many_mask, "banned_replies": banned_reply,
    "text_chunk_utf8": chunks, "context_fit": context, "context_pairs": context_pairs, "context_plain": context_plain,
    "context_dialog": dialog, "context_tokens": tokens, "page_paragraphs": paragraphs, "page_research": research,
    "citation_apa": apa, "citation_references": references, "citation_inserted": cited, "preference_fields": pairs,
    "preference_dataset": dataset, "text_sha": fingerprints,
}

_M = """messages AS (
  SELECT conv_id || '-' || turn AS msg_id, conv_id, turn, role, make_timestamp((1704067200 + conv_id * 613 + turn * 37) * 1000000) AS create_time,
    CASE WHEN turn % 5 = 0 THEN 'bot ' || text WHEN turn % 5 = 3 THEN '@helper ' || text
         WHEN turn % 7 = 6 THEN '「' || text || '」' || chr(10) || '- - - - - - -' || chr(10) || 'ok' ELSE text END AS content,
    CASE WHEN role = 'assistant' THEN 'BOT' ELSE printf('U%03d', conv_id % 50) END AS from_user_id, printf('P%03d', conv_id % 50) AS other_user_id,
    printf('U%03d', conv_id % 50) AS actual_user_id, conv_id % 2 = 1 AS is_group, 'room ' || (conv_id % 7) AS group_name,
    'G' || (conv_id % 7) AS group_id, turn % 3 = 0 AS is_at FROM conversations)"""
_KEY = "CASE WHEN is_group THEN CASE WHEN group_name = 'room 3' THEN group_id ELSE actual_user_id END ELSE other_user_id END"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))
_HITS = f"""words AS (SELECT * FROM (VALUES {_WORDS}) AS v(k, w)),
hits AS (SELECT msg_id, content, w AS keyword, CAST(i - 1 AS INT) AS start, CAST(i - 2 + length(w) AS INT) AS "end", CAST(k AS INT) AS "index"
  FROM messages, words, range(1, 3000) AS r(i) WHERE i <= length(content) AND substr(content, i, length(w)) = w)"""
_MASK = f"""{_HITS}, masked AS (SELECT m.msg_id, coalesce(string_agg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.msg_id = m.msg_id AND i - 1 BETWEEN h.start AND h."end")
  THEN '*' ELSE substr(content, i, 1) END, '' ORDER BY i), '') AS masked FROM messages m, range(1, 3000) AS r(i) WHERE i <= length(content) GROUP BY m.msg_id)"""
_MANY = f"""top AS (SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT {MANY}),
spots AS (SELECT msg_id, i, n, substr(content, i, n) AS w FROM messages, (SELECT DISTINCT length(w) AS n FROM top), range(1, 3000) AS r(i)
  WHERE i + n - 1 <= length(content)),
many AS (SELECT msg_id, w AS keyword, i - 1 AS start, n FROM spots JOIN top USING (w))"""
_CHUNKS = """RECURSIVE cut AS (
  SELECT doc_id, m, size, 0 AS pos, text AS rest, '' AS chunk FROM documents, (VALUES (0, 500), (4, 90)) AS v(m, size)
  UNION ALL
  SELECT doc_id, m, size, pos + 1, substr(rest, k + 1), substr(rest, 1, k)
  FROM (SELECT *, CASE WHEN m > 0 AND pos = m THEN length(rest)
          ELSE list_max(list_filter(range(size // 4, size + 1), lambda j: strlen(substr(rest, 1, j)) <= size)) END AS k FROM cut WHERE rest <> ''))"""
_ANY = "(" + " OR ".join(f"contains(content, '{w}')" for w in WORDS) + ")"

_RENDER = """CASE role WHEN 'system' THEN text || '<|endoftext|>' || chr(10) || chr(10) || chr(10) WHEN 'user' THEN 'Q: ' || text || chr(10)
  ELSE chr(10) || chr(10) || 'A: ' || text || '<|endoftext|>' || chr(10) END"""
_PLAIN = f"""r AS (SELECT *, {_RENDER} AS line, last_value(role) OVER w2 AS last_role, last_value(turn) OVER w2 AS last_turn FROM conversations
  WINDOW w2 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tails AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail FROM r),
kept AS (SELECT * FROM tails WHERE tail + CASE WHEN last_role = 'user' THEN 3 ELSE 0 END <= {BUDGET} OR (turn = last_turn AND role <> 'assistant'))"""

_BLOCKS = "|".join(R.BLOCK_TAGS)


def _para(html: str) -> str:
    text = f"regexp_replace(regexp_replace(x, '(?is)^<p(\\s[^>]*)?>', ''), '<[^>]*>', '', 'g')"
    for k, v in R.ENTITIES.items():
        text = f"replace({text}, '{k}', {'chr(39)' if v == chr(39) else 'chr(160)' if v == chr(160) else repr(v)})"
    pieces = f"string_split(regexp_replace({html}, '(?is)(</?({_BLOCKS})[\\s>/])', chr(1) || '\\1', 'g'), chr(1))"
    return (f"list_filter(list_transform(list_filter({pieces}, lambda x: regexp_matches(x, '(?is)^<p(\\s[^>]*)?>')), lambda x: {text}),"
            " lambda t: length(t) > 50)")


_PARA = f"(SELECT page_id, url, html, {_para('html')} AS ps FROM pages)"
_PTEXT = f"CASE WHEN len(ps) > 0 THEN array_to_string(ps[1:5], chr(10)) ELSE '{R.NO_TEXT}' END"

_W = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


def _w(i: int) -> str:
    return f"coalesce(w[{i + 1}], 'x')"


_PAPERS = f"""papers AS (SELECT doc_id AS paper_id, source || '-' || lang AS topic, text,
  {_w(5)} || ' ' || {_w(6)} || ': ' || upper(lower({_w(7)})[1]) || lower({_w(7)})[2:] || ' ' || {_w(8)} AS title,
  CASE n_chars % 3 WHEN 0 THEN {_w(2)} || '-' || {_w(0)}[1] || {_w(1)}[1] WHEN 1 THEN {_w(1)} || '-' || {_w(0)}[1] || ', ' || {_w(2)}
    ELSE {_w(1)} || '-' || {_w(0)}[1] || ', ' || {_w(2)} || ', ' || {_w(4)} || '-' || {_w(3)}[1] END AS authors,
  CASE WHEN lang = 'de' THEN {_w(9)} || ', ' || (1990 + n_chars % 30)
       ELSE {_w(9)} || ' - ' || source || CASE WHEN lang <> 'es' THEN ', ' || (1990 + n_chars % 30) ELSE '' END || ' - web' END AS summary,
  'https://example.com/' || doc_id AS link FROM (SELECT *, {_W} AS w FROM documents)),
apa AS (SELECT *, coalesce(nullif(regexp_extract(summary, '\\b([0-9]{{4}})\\b', 1), ''), 'n.d.') AS year FROM papers),
ref AS (SELECT *, authors || '. (' || year || '). ' || title || '. ' || coalesce(string_split(summary, ' - ')[2], 'Unknown Journal') || '. DOI: ' || link AS apa,
  string_split(authors, ', ') AS al FROM apa),
who AS (SELECT *, CASE len(al) WHEN 1 THEN al[1] WHEN 2 THEN al[1] || ' et ' || al[2] ELSE al[1] || ' et al' END AS w FROM ref)"""

_INSERT = r"""bits AS (SELECT paper_id, list_filter(flatten(list_transform(string_split_regex(text, '[.!?]'), lambda b, i: [b, regexp_extract_all(text, '[.!?]')[i]])),
    lambda x: x IS NOT NULL) AS p, ['(' || w || ', ' || year || ')[1]', '(' || w || ', ' || year || ')[2]', '(' || w || ', ' || year || ')[3]'] AS c FROM who),
piece AS (SELECT paper_id, c, least(len(p) // 3, 3) AS k, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM bits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY md5(paper_id || ':' || i), i) <= k AND NOT regexp_matches(x, '^\s*#+\s') AS pick FROM piece),
nth AS (SELECT *, count(*) FILTER (pick) OVER (PARTITION BY paper_id ORDER BY i) AS n FROM ranked)
SELECT paper_id, string_agg(CASE WHEN pick THEN trim(x) || ' ' || c[n] ELSE x END, '' ORDER BY i) AS cited_text FROM nth GROUP BY paper_id"""

_PAIRS = """pairs AS (SELECT a.conv_id || '-' || a.turn AS pair_id, a.text AS prompt, CASE WHEN b.role = 'assistant' THEN b.text END AS chosen,
  CASE WHEN c.role = 'assistant' THEN c.text END AS rejected FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 3 WHERE a.role = 'user')"""

ORACLE = {
    "chat_route": rf"""WITH {_M}, m AS (SELECT *, CASE WHEN starts_with(content, 'bot') THEN 'bot' WHEN starts_with(content, '@helper') THEN '@helper' END AS p FROM messages
  WHERE NOT contains(content, '」' || chr(10) || '- - - - - - -') AND from_user_id <> 'BOT'),
s AS (SELECT *, CASE WHEN p IS NULL THEN content ELSE {_STRIP.format('substr(content, length(p) + 1)')} END AS c FROM m)
SELECT msg_id, {_STRIP.format("CASE WHEN is_group AND is_at THEN regexp_replace(c, '@helper( | )', '', 'g') ELSE c END")} AS content,
  {_KEY} AS session_id, is_group FROM s
WHERE CASE WHEN is_group THEN (group_name IN ('room 1', 'room 3') OR contains(group_name, '5')) AND (p IS NOT NULL OR contains(content, 'tion') OR is_at) ELSE p IS NOT NULL END""",
    "chat_prefix": f"""WITH {_M} SELECT msg_id, CASE WHEN starts_with(content, 'bot') THEN 'bot' WHEN starts_with(content, '@helper') THEN '@helper'
  WHEN starts_with(content, 'b') THEN 'b' END AS prefix, contains(content, 'tion') OR contains(content, 'que') AS hit FROM messages""",
    "chat_mention": f"""WITH {_M}, s AS (SELECT *, regexp_replace(content, '@helper( | )', '', 'g') AS a FROM messages)
SELECT msg_id, CASE WHEN a = content THEN regexp_replace(content, '@bot( | )', '', 'g') ELSE a END AS content FROM s""",
    "chat_service_hours": f"WITH {_M} SELECT msg_id FROM messages WHERE strftime(create_time, '%H:%M') BETWEEN '08:30' AND '17:45'",
    "chat_session_key": f"WITH {_M} SELECT {_KEY} AS session_id, count(*) AS n FROM messages GROUP BY 1",
    "chat_keyword_reply": """WITH r AS (SELECT p_name AS k, min('https://example.com/' || replace(p_name, ' ', '-') || CASE WHEN contains(p_name, 'red') THEN '.png' ELSE '.html' END) AS reply FROM part GROUP BY 1)
SELECT p_partkey AS msg_id, reply, CASE WHEN reply LIKE '%.png' THEN 'IMAGE_URL' ELSE 'TEXT' END AS reply_type FROM part JOIN r ON k = CASE WHEN p_size > 25 THEN p_name ELSE p_type END""",
    "chat_app_lookup": f"""WITH {_M}, apps AS (SELECT 'room ' || (n_nationkey % 4) AS name, max(n_name) AS app FROM nation GROUP BY 1)
SELECT group_name, coalesce(app, (SELECT max(r_name) FROM region)) AS app, count(*) AS n FROM messages LEFT JOIN apps ON name = group_name GROUP BY 1, 2""",
    "banned_find": f"WITH {_M}, {_HITS} SELECT msg_id, keyword, start, \"end\", \"index\" FROM hits",
    "banned_first": f"""WITH {_M}, {_HITS} SELECT msg_id, keyword, start, "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY "end", start) AS k FROM hits) WHERE k = 1""",
    "banned_mask": f"WITH {_M}, {_MASK} SELECT msg_id, masked FROM masked",
    "banned_documents": """SELECT w AS keyword, CAST(sum((length(text) - length(replace(text, w, ''))) // length(w)) AS BIGINT) AS n, count(*) AS docs
FROM documents, (VALUES ('wingthth'), ('token'), ('http')) AS v(w) WHERE contains(text, w) GROUP BY 1""",
    "banned_actions": f"""WITH {_M}, {_MASK} SELECT msg_id, 'ignore' AS action, NULL AS reply FROM messages WHERE NOT {_ANY}
UNION ALL SELECT msg_id, 'replace', CASE WHEN {_ANY} THEN '发言中包含敏感词，请重试: ' || chr(10) || masked END FROM messages JOIN masked USING (msg_id)""",
    "text_chunk_utf8": f"WITH {_CHUNKS} SELECT doc_id, CAST(pos - 1 AS INT) AS pos, chunk, CAST(m AS INT) AS max_split FROM cut WHERE pos > 0",
    "banned_many": f"""WITH {_M}, {_MANY}
SELECT keyword, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, count(DISTINCT msg_id) AS messages FROM many GROUP BY 1""",
    "banned_many_mask": f"""WITH {_M}, {_MANY}, covered AS (SELECT DISTINCT msg_id, unnest(range(start + 1, start + n + 1)) AS i FROM many)
SELECT msg_id, coalesce(string_agg(CASE WHEN c.i IS NULL THEN substr(content, p.i, 1) ELSE '*' END, '' ORDER BY p.i), '') AS masked
FROM (SELECT msg_id, content, unnest(range(1, length(content) + 1)) AS i FROM messages) p LEFT JOIN covered c USING (msg_id, i) GROUP BY msg_id
UNION ALL SELECT msg_id, content FROM messages WHERE content = ''""",
    "banned_replies": f"""WITH r AS (SELECT conv_id || '-' || turn AS msg_id, text AS content, CASE WHEN turn % 4 = 3 THEN 'IMAGE_URL' ELSE 'TEXT' END AS t FROM conversations WHERE role = 'assistant'),
messages AS (SELECT * FROM r), {_MASK}
SELECT msg_id, t AS reply_type, content AS reply, 'ignore' AS action FROM r WHERE t <> 'TEXT' OR NOT {_ANY}
UNION ALL SELECT msg_id, CASE WHEN t = 'TEXT' AND {_ANY} THEN 'INFO' ELSE t END,
  CASE WHEN t = 'TEXT' AND {_ANY} THEN '已替换回复中的敏感词: ' || chr(10) || masked ELSE content END, 'replace' FROM r JOIN masked USING (msg_id)""",
    "context_fit": f"""WITH t AS (SELECT *, sum(length(text) + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail, max(turn) OVER (PARTITION BY conv_id) AS last
  FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, sum(length(text) + 4) AS sys FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT conv_id, turn, role FROM conversations WHERE role = 'system'
UNION ALL SELECT conv_id, turn, role FROM t LEFT JOIN s USING (conv_id) WHERE tail + coalesce(sys, 0) + 3 <= {BUDGET} OR (turn = last AND role = 'user')""",
    "context_pairs": f"""WITH t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS pair, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE role <> 'system'),
p AS (SELECT conv_id, pair, sum(sum(length(text))) OVER (PARTITION BY conv_id ORDER BY pair DESC) AS tail FROM t GROUP BY 1, 2)
SELECT conv_id, turn, role FROM t JOIN p USING (conv_id, pair) WHERE tail <= {BUDGET} OR (n % 2 = 1 AND pair = (n - 1) // 2)""",
    "context_plain": f"WITH {_PLAIN} SELECT conv_id, turn, role FROM kept",
    "context_dialog": f"""WITH {_PLAIN} SELECT conv_id, string_agg(line, '' ORDER BY turn) || CASE WHEN any_value(last_role) = 'user' THEN 'A: ' ELSE '' END AS dialog
FROM kept GROUP BY conv_id""",
    "context_tokens": """SELECT conv_id, CAST(sum(length(text) + 4) + 3 AS BIGINT) AS tokens, 'gpt-3.5' AS form FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, CAST(sum(length(text) + 3) + 3 AS BIGINT), 'gpt-4' FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, CAST(sum(length(text)) AS BIGINT), 'plain' FROM conversations GROUP BY 1""",
    "page_paragraphs": f"SELECT page_id, {_PTEXT} AS paragraphs FROM {_PARA}",
    "page_research": f"""WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM {_PARA})
SELECT host, page_id, chr(10) || '标题: ' || title || chr(10) || {_PTEXT} || chr(10) || chr(10) || repeat('=', 80) || chr(10) AS block FROM p""",
    "citation_apa": f"WITH {_PAPERS} SELECT paper_id, apa FROM ref",
    "citation_references": f"""WITH {_PAPERS}, n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY paper_id) AS i FROM who)
SELECT topic, CAST(i AS INT) AS "index", '[' || i || '] ' || apa AS reference, '(' || w || ', ' || year || ')[' || i || ']' AS citation FROM n WHERE i <= 25""",
    "citation_inserted": f"WITH {_PAPERS}, {_INSERT}",
    "preference_fields": f"WITH {_PAIRS} SELECT pair_id, chosen IS NOT NULL AND rejected IS NOT NULL AS ok FROM pairs",
    "preference_dataset": f"""WITH {_PAIRS} SELECT pair_id, prompt || chr(10) || chr(10) || '回答：' || chosen AS chosen_text, prompt || chr(10) || chr(10) || '回答：' || rejected AS rejected_text,
  CASE WHEN CAST('0x' || substr(md5(pair_id || ':0'), 1, 8) AS BIGINT) % 1000 < 200 THEN 'test' ELSE 'train' END AS part
FROM pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL""",
    "text_sha": "SELECT doc_id, substr(sha256(text), 1, 16) AS sha, substr(text, 4) AS rest FROM documents",
}
