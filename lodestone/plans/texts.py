"""Scalar text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import frames as S
from ..sources import replies
from .registry import query

WS = r"[ \t\n\x0b\f\r]"


def docs(spark, d):
    return S.table(spark, d, "documents")


def pages(spark, d):
    return S.table(spark, d, "pages")


def _strip(x):
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _all(x, pattern):
    return f"regexp_extract_all({x}, '{pattern}')"


@query("fn_normalize_url", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(https?://[^/]+/job/[0-9]+)', 1), ''), split_part(split_part(url, '?', 1), '#', 1)) AS url FROM (SELECT page_id, url FROM pages UNION ALL SELECT -1 - id, url FROM jds)", ("jds",))
def fn_normalize_url(spark, d):
    both = pages(spark, d).select("page_id", "url").unionByName(S.jds(spark, d).selectExpr("-1 - id AS page_id", "url"))
    return both.select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("fn_extract_job_id", r"SELECT id, regexp_extract(url, '/job/([0-9]+)', 1) AS job FROM jds UNION ALL SELECT page_id + 10000000, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)/?$', 1) FROM pages", ("jds",))
def fn_extract_job_id(spark, d):
    both = S.jds(spark, d).select("id", "url").unionByName(pages(spark, d).selectExpr("page_id + 10000000 AS id", "url"))
    return both.select("id", T.job_id(F.col("url")).alias("job"))


@query("fn_detect_language", "SELECT doc_id, CASE WHEN length(text) < 20 THEN 'mixed' WHEN len(regexp_extract_all(text, '[一-鿿　-〿＀-￯]')) / length(text) > 0.3 THEN 'zh' WHEN len(regexp_extract_all(text, '[一-鿿　-〿＀-￯]')) / length(text) < 0.05 THEN 'en' ELSE 'mixed' END AS language FROM documents")
def fn_detect_language(spark, d):
    return docs(spark, d).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("fn_is_zh", f"SELECT doc_id, coalesce(len(regexp_extract_all(t, '[一-鿿　-〿]')) / nullif(length(t), 0) > 0.2, false) AS zh, coalesce(len(regexp_extract_all(t, '[a-zA-Z]')) / nullif(length(t), 0) > 0.7, false) AS english FROM (SELECT doc_id, {S.SCRIPTS} AS t FROM documents)")
def fn_is_zh(spark, d):
    rows = docs(spark, d).selectExpr("doc_id", f"{S.SCRIPTS} AS t")
    return rows.select("doc_id", T.is_zh(F.col("t")).alias("zh"), T.is_english(F.col("t")).alias("english"))


@query("fn_tokenize", "SELECT doc_id, len(t) AS n, list_distinct(t).list_sort().list_aggregate('string_agg', ' ') AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]') AS t FROM documents)")
def fn_tokenize(spark, d):
    t = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.nullif(F.array_join(F.array_sort(F.array_distinct("t")), " "), F.lit("")).alias("words"))


_TOKENS = r"CAST(floor(len(regexp_extract_all(text, '[\p{L}\p{N} .,!?\-]')) * 0.25 + (length(text) - len(regexp_extract_all(text, '[\p{L}\p{N} .,!?\-]'))) * 0.5) AS BIGINT)"


@query("fn_estimate_tokens", f"SELECT conv_id, turn, {_TOKENS} AS tokens FROM conversations")
def fn_estimate_tokens(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.estimate_tokens(F.col("text")).alias("tokens"))


_CLEAN = "text"
for _p, _r in ((rf"\n{WS}*\n", r"\n\n"), (r"[ \t]+", " "), (r"Page[ \t\n\x0b\f\r]*[0-9]+", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", ""), (r"\r\n", r"\n"), (r"\r", r"\n")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {'chr(10)' if _r == chr(92) + 'n' else 'chr(10) || chr(10)' if _r == chr(92) + 'n' + chr(92) + 'n' else repr(_r)}, 'g')"


CLEAN_SQL = _strip(_CLEAN)


@query("fn_clean_text", f"SELECT doc_id, {CLEAN_SQL} AS text FROM documents")
def fn_clean_text(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("fn_extract_emails", r"SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS emails FROM documents")
def fn_extract_emails(spark, d):
    return docs(spark, d).select("doc_id", T.emails(F.col("text")).alias("emails"))


@query("fn_extract_phones", f"SELECT doc_id, list_sort(list_distinct(list_concat({_all('text', '1[3-9][0-9]{9}')}, {_all('text', '[0-9]{3,4}-[0-9]{7,8}')}, {_all('text', '[0-9]{11}')}))) AS phones FROM documents")
def fn_extract_phones(spark, d):
    return docs(spark, d).select("doc_id", T.phones(F.col("text")).alias("phones"))


@query("fn_extract_section", f"SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>(.*?)</title>') THEN {_strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} END AS title FROM pages")
def fn_extract_section(spark, d):
    return pages(spark, d).select("page_id", T.section(F.col("html"), "<title>(.*?)</title>").alias("title"))


_FENCED = "'<think>' || substr(text, 1, 20) || '</think> ```reasoning x``` ' || text"


@query("fn_strip_thinking", rf"SELECT conv_id, turn, {_strip(r"regexp_replace(" + _strip(rf"regexp_replace({_FENCED}, '(?is)```(?:thinking|reasoning|reflection|chain_of_thought)\b.*?```', '', 'g')") + r", '(?is)<(?:think|reasoning|reflection|chain_of_thought)\b[^>]*>.*?</(?:think|reasoning|reflection|chain_of_thought)[ \t\n\x0b\f\r]*>', '', 'g')")} AS text FROM conversations")
def fn_strip_thinking(spark, d):
    fenced = F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("</think> ```reasoning x``` "), F.col("text"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.strip_thinking(fenced).alias("text"))


_ONE = _strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")


@query("fn_summarize", f"SELECT doc_id, CASE WHEN length(one) <= 80 THEN one ELSE coalesce(nullif(regexp_extract(substr(one, 1, 80), '^(.*) [^ ]*$', 1), ''), substr(one, 1, 80)) || '…' END AS summary FROM (SELECT doc_id, {_ONE} AS one FROM documents)")
def fn_summarize(spark, d):
    return docs(spark, d).select("doc_id", T.summarize(F.col("text"), 80).alias("summary"))


_CUTS = " ".join(f"WHEN contains(head, {m}) AND length(head) - strpos(reverse(head), {m}) > 66 THEN substr(head, 1, length(head) - strpos(reverse(head), {m}) + 1)" for m in ("'。'", "'.'", "'！'", "'!'", "'?'", "chr(10)"))


@query("fn_truncate_sentence", f"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text {_CUTS} ELSE head || '…' END AS head FROM (SELECT doc_id, text, substr(text, 1, 200) AS head FROM documents)")
def fn_truncate_sentence(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_sentence(F.col("text"), 200).alias("head"))


@query("fn_excerpt", f"SELECT doc_id, CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') || '…' ELSE text END AS head FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents)")
def fn_excerpt(spark, d):
    return docs(spark, d).select("doc_id", T.excerpt(F.col("text"), 30).alias("head"))


def packed(parts: str, key: str, most: int, joined: str) -> str:
    """Common table expressions that end in ``pieces`` (key, part, text): the parts (key, i from 1 on, p)
    joined greedily up to ``most`` characters. joined: how p follows x."""
    fits = f"length(x) + length(p) <= {most}"
    return f"""parts AS ({parts}), r AS (SELECT DISTINCT {key}, 0::BIGINT AS i, 0 AS part, '' AS x FROM parts
      UNION ALL SELECT {", ".join(f"r.{k.strip()}" for k in key.split(","))}, parts.i, CASE WHEN {fits} OR x = '' THEN part ELSE part + 1 END, CASE WHEN {fits} THEN CASE WHEN x = '' THEN p ELSE {joined} END ELSE p END FROM r JOIN parts ON {" AND ".join(f"parts.{k.strip()} = r.{k.strip()}" for k in key.split(","))} AND parts.i = r.i + 1),
      pieces AS (SELECT {key}, part, arg_max(x, i) AS text FROM r GROUP BY {key}, part)"""


_CUT = r"'([。.!?！？])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'"


def sentences(rows: str, key: str, text: str, most: int = 800) -> str:
    """Parts of ``packed`` for texts of more than ``most`` characters: their sentences."""
    return f"SELECT {key}, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p FROM (SELECT {key}, string_split(regexp_replace({text}, {_CUT}), chr(1)) AS l FROM ({rows}) WHERE length({text}) > {most})"


_PARAGRAPHS = rf"SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\n{WS}*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)"


@query("fn_split_long_text", f"WITH RECURSIVE {packed(_PARAGRAPHS, 'doc_id', 4000, 'x || p')} SELECT doc_id, part, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM pieces WHERE text <> ''")
def fn_split_long_text(spark, d):
    parts = docs(spark, d).select("doc_id", F.posexplode(T.split_long_text(F.col("text"))).alias("part", "text"))
    return parts.select("doc_id", "part", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("fn_cap_length", f"WITH RECURSIVE {packed(sentences('SELECT doc_id, text FROM documents', 'doc_id', 'text'), 'doc_id', 800, "trim(x || ' ' || p)")} SELECT doc_id, part, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, part, text FROM pieces WHERE text <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 800)")
def fn_cap_length(spark, d):
    parts = docs(spark, d).select("doc_id", F.posexplode(T.cap_length(F.col("text"))).alias("part", "text"))
    return parts.select("doc_id", "part", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("fn_parse_salary_range", "SELECT doc_id, coalesce(try_cast(regexp_extract(text, '([0-9]+)[^0-9]+([0-9]+)', 1) AS INTEGER), try_cast(regexp_extract(text, '([0-9]+)', 1) AS INTEGER)) AS low, coalesce(try_cast(regexp_extract(text, '([0-9]+)[^0-9]+([0-9]+)', 2) AS INTEGER), try_cast(regexp_extract(text, '([0-9]+)', 1) AS INTEGER)) AS high FROM documents")
def fn_parse_salary_range(spark, d):
    return docs(spark, d).select("doc_id", T.salary_range(F.col("text")).alias("s")).select("doc_id", "s.low", "s.high")


def _int(pattern, group=1):
    return f"try_cast(regexp_extract(t, '{pattern}', {group}) AS INTEGER)"


_PAIR, _OVER, _UNDER, _ONE = "(?i)([0-9]+)-([0-9]+)K?", "(?i)([0-9]+)K以上", "(?i)([0-9]+)K以下", "(?i)([0-9]+)K"


@query("fn_parse_salary_boss", rf"SELECT doc_id, CASE WHEN regexp_matches(t, '{_PAIR}') THEN {_int(_PAIR)} WHEN regexp_matches(t, '{_OVER}') THEN {_int(_OVER)} WHEN regexp_matches(t, '{_UNDER}') THEN NULL ELSE {_int(_ONE)} END AS low, CASE WHEN regexp_matches(t, '{_PAIR}') THEN {_int(_PAIR, 2)} WHEN regexp_matches(t, '{_OVER}') THEN NULL WHEN regexp_matches(t, '{_UNDER}') THEN {_int(_UNDER)} ELSE {_int(_ONE)} END AS high FROM (SELECT doc_id, regexp_replace({S.PAY_K}, '[薪\s]', '', 'g') AS t FROM documents)")
def fn_parse_salary_boss(spark, d):
    return docs(spark, d).selectExpr("doc_id", f"{S.PAY_K} AS t").select("doc_id", T.salary_k(F.col("t")).alias("s")).select("doc_id", "s.low", "s.high")


_K = "try_cast(replace(l[{}], ',', '') AS BIGINT) * CASE WHEN contains(lower(t), 'k') THEN 1000 ELSE 1 END // 1000"


@query("fn_parse_salary_jobsdb", f"SELECT doc_id, CAST({_K.format(1)} AS INTEGER) AS low, CAST(coalesce({_K.format(2)}, {_K.format(1)}) AS INTEGER) AS high FROM (SELECT doc_id, t, regexp_extract_all(t, '[0-9,]+') AS l FROM (SELECT doc_id, {S.PAY} AS t FROM documents))")
def fn_parse_salary_jobsdb(spark, d):
    return docs(spark, d).selectExpr("doc_id", f"{S.PAY} AS t").select("doc_id", T.salary_thousands(F.col("t")).alias("s")).select("doc_id", "s.low", "s.high")


_DAYS, _WEEKS = r"Posted ([0-9]+)d\+? ago", "Posted ([0-9]+)w ago"


@query("fn_days_old", rf"SELECT doc_id, CASE WHEN regexp_matches(t, '{_DAYS}') THEN {_int(_DAYS)} WHEN regexp_matches(t, '{_WEEKS}') THEN {_int(_WEEKS)} * 7 WHEN contains(t, 'Posted yesterday') THEN 1 WHEN contains(t, 'Posted today') THEN 0 ELSE try_cast(regexp_extract(lower(t), '([0-9]+)d\+?\s+ago', 1) AS INTEGER) END AS days FROM (SELECT doc_id, {S.AGE} AS t FROM documents)")
def fn_days_old(spark, d):
    return docs(spark, d).selectExpr("doc_id", f"{S.AGE} AS t").select("doc_id", T.days_old(F.col("t")).alias("days"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in sorted(T.SKILLS)) + "]"


@query("fn_extract_skills_dict", f"SELECT doc_id, list_sort(list_filter({_NAMES}, lambda n: contains(lower(text), lower(n)))) AS skills FROM documents")
def fn_extract_skills_dict(spark, d):
    return docs(spark, d).select("doc_id", T.skills_in(F.col("text")).alias("skills"))


_WALL = "(contains(lower(html), 'captcha') OR contains(lower(html), 'verify') OR contains(lower(html), 'blocked') OR contains(lower(html), 'access denied') OR contains(lower(html), 'security check') OR contains(lower(html), 'manual auth') OR contains(lower(html), 'verification'))"


@query("fn_anti_bot", f"SELECT page_id, {_WALL} AS wall FROM pages")
def fn_anti_bot(spark, d):
    return pages(spark, d).select("page_id", T.holds_any(F.col("html"), T.ANTI_BOT).alias("wall"))


_WORDS = " OR ".join(f"contains(lower(said), '{w.lower()}')" for w in T.ANTI_BOT)
_TITLES = ", ".join(f"'{t}'" for t in T.WALL_TITLES)


@query("fn_is_garbage", f"SELECT doc_id, coalesce(source IN ('liepin_batch', 'jobsdb_batch', 'smart_collector', 'crawler', 'jd_crawler', '51job_batch'), false) AND ({_WORDS}) AND (length(trim(raw_text)) < 300 OR title = '' OR company = '' OR title IN ({_TITLES}) OR coalesce(position_tag, '') = '') AS garbage FROM (SELECT * REPLACE (trim(coalesce(title, '')) AS title, trim(coalesce(company, '')) AS company), concat_ws(chr(10), title, company, raw_text) AS said FROM (SELECT doc_id, {S.CRAWLED_ROW} FROM documents))")
def fn_is_garbage(spark, d):
    """Crawled sources, words of a bot check, and each sign of a weak posting."""
    rows = docs(spark, d).selectExpr("doc_id", *S.fields(S.CRAWLED_ROW))
    return rows.select("doc_id", T.is_garbage("source", "title", "company", "raw_text", F.nullif("position_tag", F.lit(""))).alias("garbage"))


@query("fn_chunk_id", "SELECT doc_id, 'chunk_' || regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g') || '_' || (doc_id % 9) || '_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 4, '0') AS id FROM documents")
def fn_chunk_id(spark, d):
    return docs(spark, d).select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id") % 9, F.col("doc_id") % 1000).alias("id"))


@query("fn_cache_key", "SELECT doc_id, md5(lang || '|' || source) AS key, substr(sha1(text), 1, 16) AS text_key FROM documents")
def fn_cache_key(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.concat_ws("|", "lang", "source")).alias("key"), F.substring(F.sha1("text"), 1, 16).alias("text_key"))


def _route(text, branches, other):
    return "CASE " + " ".join(f"WHEN {more}({' OR '.join(f"contains({text}, '{w}')" for w in words)}) THEN '{name}'" for name, more, words in branches) + f" ELSE '{other}' END"


@query("fn_doc_type", f"SELECT doc_id, coalesce(nullif(m ->> '$.document_type', ''), nullif(m ->> '$.doc_type', ''), nullif(m ->> '$.type', ''), {_route("lower(coalesce(m ->> '$.document_title', ''))", [(n, '', w) for n, w in T.DOC_TYPES], T.ANY_DOC_TYPE)}) AS kind FROM (SELECT doc_id, CASE WHEN json_valid(m) THEN CAST(m AS JSON) END AS m FROM (SELECT doc_id, {S.METADATA} AS m FROM documents))")
def fn_doc_type(spark, d):
    """Metadata are a variant, by path; what is no JSON names no type."""
    return docs(spark, d).selectExpr("doc_id", f"try_parse_json({S.METADATA}) AS m").select("doc_id", T.doc_type(F.col("m")).alias("kind"))


@query("fn_keyword_route", f"SELECT conv_id, turn, {_route("lower(coalesce(m, ''))", [(n, f'length(m) > {T.LONG_MESSAGE} AND ' if long else '', w) for n, long, w in T.CHAT_BRANCHES], 'model')} AS branch FROM (SELECT conv_id, turn, {S.MESSAGE} AS m FROM conversations)")
def fn_keyword_route(spark, d):
    return S.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{S.MESSAGE} AS m").select("conv_id", "turn", T.chat_branch(F.col("m")).alias("branch"))


@query("fn_filename", r"SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[\\/:*?""<>|\r\n\t]+', '', 'g'), '^[ .]+|[ .]+$', '', 'g') || '_' || p_brand || '.docx' AS name FROM part")
def fn_filename(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.filename(F.col("p_name"), F.col("p_brand")).alias("name"))


@query("fn_json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def fn_json_get(spark, d):
    return S.table(spark, d, "events").select("event_id", T.json_number(F.col("props"), "k").alias("k"))


_LOOSE = r"coalesce(nullif(" + _strip(r"regexp_extract(r, '(?s)```(?:json)?\s*(.*?)```', 1)") + r", ''), nullif(regexp_extract(r, '(?s)(\{.*\})', 1), ''), r)"


@query("fn_json_loose", f"SELECT event_id, k, list_concat(list_transform(CASE WHEN k IS NULL THEN [NULL] ELSE [k % 9] END, lambda x: CAST(CASE WHEN x IS NULL THEN 3 ELSE least(5, greatest(1, x)) END AS INTEGER)), [3, 3]) AS scores FROM (SELECT event_id, CASE WHEN json_valid(j) THEN try_cast(json_extract_string(j, '$.k') AS BIGINT) END AS k FROM (SELECT event_id, {_LOOSE} AS j FROM (SELECT event_id, {S.REPLY} AS r FROM events)))")
def fn_json_loose(spark, d):
    """JSON in a fence, between words, or none; scores from 1 to 5, missing ones filled up."""
    rows = S.table(spark, d, "events").selectExpr("event_id", f"{S.REPLY} AS r")
    k = F.get_json_object(T.loose_json(F.col("r")), "$.k").try_cast("bigint")
    return rows.select("event_id", k.alias("k"), T.clamp_scores(F.array((k % 9).cast("int")), 3).alias("scores"))


@query("fn_sigmoid", "SELECT event_id, 1 / (1 + exp(-(value - 50) / 10)) AS p FROM events")
def fn_sigmoid(spark, d):
    return S.table(spark, d, "events").select("event_id", T.sigmoid((F.col("value") - 50) / 10).alias("p"))


@query("fn_date", f"SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, ts >= TIMESTAMP '{S.AS_OF}' - INTERVAL 7 DAY AS recent, (epoch_us(TIMESTAMP '{S.AS_OF}') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM events")
def fn_date(spark, d):
    age = (F.unix_micros(S.as_of().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000.0)
    return S.table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("ts") >= S.as_of() - F.expr("INTERVAL '7' DAY")).alias("recent"), age.alias("age"))


_OF = r"regexp_replace({}, '(?s)<!--.*?-->', '', 'g')"
_PARTS = "list_filter(list_transform(regexp_split_to_array({}, '(?s)<[^>]*>'), lambda x: " + _strip("x") + "), lambda x: x <> '')"
_PAGE = "array_to_string(" + _PARTS.format(_OF.format(r"regexp_replace(html, '(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</(script|style|nav|footer|header)>', '', 'g')")) + ", chr(10))"


def _element(pattern, separator):
    return "array_to_string(" + _PARTS.format(_OF.format(f"regexp_extract(html, '(?is){pattern}', 1)")) + f", '{separator}')"


TITLES, BODIES = ("<h1[^>]*>(.*?)</h1>", "<title>(.*?)</title>"), ("<div[^>]*class=\"job-detail\"[^>]*>(.*?)</div>", "<article[^>]*>(.*?)</article>")
_TITLE = "coalesce(" + ", ".join(f"CASE WHEN {_element(p, '')} <> '' AND length({_element(p, '')}) < 200 THEN {_element(p, '')} END" for p in TITLES) + ", '')"
_BODY = "coalesce(" + ", ".join(f"CASE WHEN length({_element(p, chr(10))}) > 50 THEN {_element(p, chr(10))} END" for p in BODIES) + ", array_to_string(list_filter(string_split(" + _PAGE + ", chr(10)), lambda x: length(x) > 20 OR " + " OR ".join(f"contains(lower(x), '{w}')" for w in replies.DESCRIBING) + ")[1:20], chr(10)))"


@query("scan_html", f"SELECT page_id, {_TITLE} AS title, {_BODY} AS text FROM pages")
def scan_html(spark, d):
    """Title and description of a page: the first element of a list with text of fitting length, else long lines of the page."""
    html = F.col("html")
    return pages(spark, d).select("page_id", replies.by_selectors(html, TITLES).alias("title"), replies.description(html, BODIES).alias("text"))


_INDEED_SQL = "coalesce(" + ", ".join(f"CASE WHEN length({_element('', chr(10)).replace('(?is)', '(?s)' + p)}) > 50 THEN {_element('', chr(10)).replace('(?is)', '(?s)' + p)} END" for p in replies.INDEED) + ", nullif(substr(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>', 1), lambda x: array_to_string(" + _PARTS.format(_OF.format("x")).replace("lambda x:", "lambda y:").replace(_strip("x"), _strip("y")).replace("x <> ''", "y <> ''") + ", '')), lambda x: x <> ''), chr(10)), 1, 10000), ''))"


@query("scan_indeed_page", f"SELECT page_id, {_INDEED_SQL} AS text FROM (SELECT page_id, {S.INDEED_PAGE} AS html FROM pages)")
def scan_indeed_page(spark, d):
    """Description of a posting from its page at the third site."""
    return pages(spark, d).selectExpr("page_id", f"{S.INDEED_PAGE} AS html").select("page_id", replies.indeed_description(F.col("html")).alias("text"))


#: Replies of two sites as JSON text, from a part, and the fields that they are made of.
_BOSS = "CASE p_partkey % 3 WHEN 0 THEN '{\"id\": \"' || p_partkey || '\", \"job_detail\": {\"job_name\": \" ' || p_name || ' \", \"company\": {\"name\": \"' || p_brand || '\"}, \"area\": \"A\", \"district\": \"B\", \"salary_low\": ' || p_size || ', \"salary_high\": 99, \"job_experience\": {\"name\": \"3 y\"}, \"description\": \"优先 ' || p_type || '\", \"requirements\": \"5年以上 SQL语言\"}}' WHEN 1 THEN '{\"id\": \"' || p_partkey || '\", \"job_name\": \"\", \"company_name\": \"' || p_brand || '\", \"city_name\": \"C\", \"salary\": \"10K\", \"education\": \"BSc\", \"job_desc\": \"d\", \"href\": \"http://x/' || p_partkey || '\"}' ELSE '{}' END"
_LAGOU = "CASE p_partkey % 2 WHEN 0 THEN '{\"positionName\": \"' || p_name || '\", \"companyFullName\": \"' || p_brand || '\", \"label\": \"a, b,,\", \"positionAdvantage\": \"food\", \"href\": \"/jobs/' || p_partkey || '.html\", \"salary\": \"1k\"}' ELSE '{\"companyShortName\": \"S\", \"companyFullName\": \"F\", \"district\": \" D \", \"jobDesc\": \" one \", \"skills\": \"two\", \"href\": \"http://y\"}' END"


@query("scan_http_json", """SELECT p_partkey AS id, 'boss' AS site, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'Untitled' END AS title, CASE p_partkey % 3 WHEN 2 THEN 'Unknown' ELSE p_brand END AS company, CASE p_partkey % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'C' ELSE '' END AS location, CASE p_partkey % 3 WHEN 0 THEN p_size || '-99' WHEN 1 THEN '10K' ELSE '' END AS salary_str,
    CASE p_partkey % 3 WHEN 0 THEN '3 y' ELSE '' END AS experience_level, CASE p_partkey % 3 WHEN 1 THEN 'BSc' ELSE '' END AS education, CASE p_partkey % 3 WHEN 0 THEN '优先 ' || p_type || chr(10) || '5年以上 SQL语言' WHEN 1 THEN 'd' ELSE '' END AS raw_text, CASE p_partkey % 3 WHEN 0 THEN ['5', 'SQL语言'] ELSE [] END AS skills_required,
    CASE p_partkey % 3 WHEN 0 THEN list_filter(list_concat(['优先'], regexp_extract_all(p_type, '[A-Za-z]{2,8}')), lambda x: true) ELSE [] END AS skills_nice, CASE p_partkey % 3 WHEN 0 THEN 'https://www.zhipin.com/job/detail/' || p_partkey || '.html' WHEN 1 THEN 'http://x/' || p_partkey ELSE 'https://www.zhipin.com/job/detail/.html' END AS source_url FROM part
  UNION ALL SELECT p_partkey, 'lagou', CASE p_partkey % 2 WHEN 0 THEN p_name ELSE 'Untitled' END, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE 'S' END, CASE p_partkey % 2 WHEN 0 THEN '' ELSE 'D' END, CASE p_partkey % 2 WHEN 0 THEN '1k' ELSE '' END, '', '', CASE p_partkey % 2 WHEN 0 THEN 'Detail URL: /jobs/' || p_partkey || '.html' ELSE 'one' || chr(10) || 'two' END,
    CASE p_partkey % 2 WHEN 0 THEN ['a', 'b'] ELSE [] END, CASE p_partkey % 2 WHEN 0 THEN ['food'] ELSE [] END, CASE p_partkey % 2 WHEN 0 THEN 'https://www.lagou.com/jobs/' || p_partkey || '.html' ELSE 'http://y' END FROM part""")
def scan_http_json(spark, d):
    """Rows from the replies of two sites: nested fields with fall-backs."""
    rows = S.spread(S.table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS id", f"{_BOSS} AS boss", f"{_LAGOU} AS lagou")
    one = rows.select("id", F.lit("boss").alias("site"), replies.boss_posting(F.col("boss")).alias("r")).select("id", "site", "r.*")
    return one.unionByName(rows.select("id", F.lit("lagou").alias("site"), replies.lagou_posting(F.col("lagou")).alias("r")).select("id", "site", "r.*"))
