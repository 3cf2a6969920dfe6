"""Chunking, taxonomy, and scores of postings, resumes and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import matching
from ..operators import scoring as P
from ..operators import taxonomy as X
from ..sources import frames as S
from .registry import query
from .texts import packed, sentences

NOW = f"TIMESTAMP '{S.AS_OF}'"

TREE = {"tools": {"small": ["small ring", "ring", "small bolt"], "large": ["large gear", "gear"]}, "parts": {"colour": ["red widget", "blue widget", "widget", "red ring"], "other": ["nut", "bolt", "ring", "economy"]}}
_ROWS = [(i, f, p) for i, fs in TREE.items() for f, ps in fs.items() for p in ps]
_TAX = "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{f}', '{p}', {n})" for n, (i, f, p) in enumerate(_ROWS)) + ") t(industry, function, position, ord)"
_NAMES = f"SELECT * FROM ({_TAX}) QUALIFY row_number() OVER (PARTITION BY position ORDER BY ord DESC) = 1"
_TEXT = "SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS text FROM part"
_L1 = f"SELECT id, industry, function, position FROM ({_TEXT}) x JOIN ({_NAMES}) n ON contains(x.text, n.position) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(position) DESC, ord) = 1"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_L2 = f"""SELECT id, industry, function, position, score FROM (
  WITH idf AS (SELECT token, ln((SELECT count(*) + 1 FROM ({_TAX})) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct({_TOK.format('position')})) AS token FROM ({_TAX})) GROUP BY token),
  a AS (SELECT position, token, count(*) * any_value(idf) AS w FROM (SELECT position, unnest({_TOK.format('position')}) AS token FROM ({_NAMES})) JOIN idf USING (token) GROUP BY ALL),
  b AS (SELECT id, token, count(*) * any_value(idf) AS w FROM (SELECT id, unnest({_TOK.format('text')}) AS token FROM ({_TEXT})) JOIN idf USING (token) GROUP BY ALL),
  s AS (SELECT b.id, a.position, sum(a.w * b.w) AS dot FROM a JOIN b USING (token) GROUP BY ALL)
  SELECT s.id, n.*, round(s.dot / (sqrt((SELECT sum(w * w) FROM a WHERE a.position = s.position)) * sqrt(bn.nn)), 9) AS score FROM s JOIN (SELECT id, sum(w * w) AS nn FROM b GROUP BY id) bn USING (id) JOIN ({_NAMES}) n USING (position))
  WHERE score >= {{least}} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1"""


def part_texts(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))


def taxonomy(spark):
    return X.flatten(spark, TREE)


@query("fn_taxonomy_nav", f"SELECT t.industry, t.function, list_sort(list(position)) AS positions, coalesce(any_value(n), 0) AS n_texts FROM ({_TAX}) t LEFT JOIN (SELECT industry, function, count(*) AS n FROM ({_L1}) GROUP BY ALL) c ON c.industry = t.industry AND c.function = t.function GROUP BY t.industry, t.function")
def fn_taxonomy_nav(spark, d):
    """Positions of each function of each industry, and how many texts a rule puts there."""
    nodes = taxonomy(spark).groupBy("industry", "function").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    texts = X.by_rule(part_texts(spark, d), taxonomy(spark), "id").groupBy("industry", "function").agg(F.count("*").alias("n"))
    return nodes.join(texts, ["industry", "function"], "left").select("industry", "function", "positions", F.coalesce("n", F.lit(0)).alias("n_texts"))


@query("classify_l1", _L1)
def classify_l1(spark, d):
    return X.by_rule(part_texts(spark, d), taxonomy(spark), "id")


@query("contains_theta_join", f"SELECT id, n.position FROM ({_TEXT}) x JOIN ({_NAMES}) n ON contains(x.text, n.position)")
def contains_theta_join(spark, d):
    names = F.broadcast(X.last_by_name(taxonomy(spark)).select("position"))
    return part_texts(spark, d).join(names, F.col("text").contains(F.col("position"))).select("id", "position")


@query("classify_l2_tfidf", f"SELECT id, industry, function, position, round(score, 6) AS score FROM ({_L2.format(least=0.6)})")
def classify_l2_tfidf(spark, d):
    return X.by_tfidf(part_texts(spark, d), taxonomy(spark), "id").withColumn("score", F.round("score", 6))


CLASSIFY_SQL = f"SELECT x.id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END AS layer, coalesce(a.industry, b.industry) AS industry, coalesce(a.function, b.function) AS function, coalesce(a.position, b.position) AS position FROM ({_TEXT}) x LEFT JOIN ({_L1}) a ON a.id = x.id LEFT JOIN ({_L2.format(least=0.6)}) b ON b.id = x.id"


@query("classify", CLASSIFY_SQL)
def classify(spark, d):
    return X.classify(part_texts(spark, d), taxonomy(spark), "id")


# -- chunks ---------------------------------------------------------------------------------------------


def _stripped(x):
    ws = r"[ \t\n\x0b\f\r]"
    return f"regexp_replace(regexp_replace({x}, '^{ws}+', ''), '{ws}+$', '')"


_OPENS = "CASE " + " ".join(f"WHEN length(trim(line)) <= {C.HEADING_MOST} AND regexp_matches(trim(line), '(?i)^\\s*[•\\-*0-9.)(]*\\s*({'|'.join(w.replace(chr(39), chr(39) * 2) for w in words)})[:：\\s]*$') THEN '{kind}'" for kind, words in C.HEADINGS.items()) + " END"
_CHUNKED = f"""l AS (SELECT id, unnest(range(0, len(a))) AS i, rtrim(unnest(a)) AS line FROM (SELECT id, regexp_split_to_array(raw_text, '\\r\\n|\\n|\\r') AS a FROM jds)),
  m AS (SELECT *, {_OPENS} AS opens, regexp_matches(line, '{C.BULLET}') AS bullet, trim(line) = '' AS blank FROM l),
  n AS (SELECT *, opens IS NOT NULL OR blank OR bullet AS cut, coalesce(last_value(opens IGNORE NULLS) OVER w, 'overview') AS kind, last_value(CASE WHEN opens IS NOT NULL THEN trim(line) END IGNORE NULLS) OVER w AS heading FROM m WINDOW w AS (PARTITION BY id ORDER BY i)),
  o AS (SELECT *, sum(CAST(cut OR coalesce(before, true) AS INTEGER)) OVER (PARTITION BY id ORDER BY i) AS unit FROM (SELECT *, lag(cut) OVER (PARTITION BY id ORDER BY i) AS before FROM n)),
  units AS (SELECT id, unit, min(i) AS first, any_value(kind) AS kind, any_value(heading) AS heading, {_stripped(f"string_agg(CASE WHEN bullet THEN trim(regexp_replace(line, '{C.BULLET}', '')) ELSE line END, chr(10) ORDER BY i)")} AS text FROM o WHERE opens IS NULL AND NOT blank GROUP BY id, unit),
  fit AS (SELECT * FROM units WHERE length(text) >= {C.LEAST}),
  {packed(sentences("SELECT id, unit, text FROM fit", "id, unit", "text", C.MOST), "id, unit", C.MOST, "trim(x || ' ' || p)")},
  whole AS (SELECT id, unit, part, text FROM pieces WHERE text <> '' UNION ALL SELECT id, unit, 0, text FROM fit WHERE length(text) <= {C.MOST})
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY fit.first, whole.part) - 1 AS INTEGER) AS chunk_index, fit.kind AS chunk_type, CASE WHEN fit.heading IS NULL THEN [] ELSE [fit.heading] END AS heading_path, whole.text AS chunk_text FROM whole JOIN fit USING (id, unit)
  UNION ALL SELECT id, 0, 'overview', [], substr({_stripped('raw_text')}, 1, {C.MOST}) FROM jds WHERE {_stripped('raw_text')} <> '' AND id NOT IN (SELECT id FROM fit)"""


@query("chunk_document", ", " + _CHUNKED, ("jds",), True)
def chunk_document(spark, d):
    """Typed chunks of postings: sections by headings, units of bullets and paragraphs, sentences up to a size."""
    return C.chunk_documents(S.jds(spark, d).select("id", "raw_text"))


_L = "SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_SEC = f"SELECT *, CASE WHEN length(line) < 25 AND rtrim(line) <> '' THEN 'requirement' END AS opens FROM (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rtrim(line) AS line FROM ({_L}))"


def sectioned(spark, d):
    lines = C.lines_of(S.table(spark, d, "documents"), "doc_id", "text")
    return C.sections(lines, "doc_id", F.when((F.length("line") < 25) & (F.col("line") != ""), "requirement"))


@query("win_gaps_islands_section", f"SELECT doc_id, line_no, CAST(sum(CAST(opens IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'overview') AS kind FROM ({_SEC})")
def win_gaps_islands_section(spark, d):
    """Sections opened by short lines: the running count of such lines."""
    return sectioned(spark, d).select("doc_id", F.col("at").alias("line_no"), "section", "kind")


@query("win_paragraph_group", f"SELECT doc_id, CAST(unit AS BIGINT) AS unit, min(line_no) AS line_no, count(*) AS n FROM (SELECT *, sum(CAST(cut OR coalesce(before, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS unit FROM (SELECT *, lag(cut) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (SELECT *, trim(line) = '' OR opens IS NOT NULL AS cut FROM ({_SEC})))) WHERE NOT cut GROUP BY doc_id, unit")
def win_paragraph_group(spark, d):
    found = C.units(sectioned(spark, d), "doc_id")
    return found.select("doc_id", "unit", F.col("at").alias("line_no"), F.size(F.split("text", "\n")).cast("bigint").alias("n"))


@query("fn_match_heading", f"SELECT doc_id, {_OPENS.replace('trim(line)', 'line')} AS kind FROM (SELECT doc_id, {S.HEADLINE} AS line FROM documents)")
def fn_match_heading(spark, d):
    rows = S.table(spark, d, "documents").selectExpr("doc_id", f"{S.HEADLINE} AS line")
    return rows.select("doc_id", C.heading_type(F.col("line")).alias("kind"))


@query("fn_strip_bullet", f"SELECT doc_id, trim(regexp_replace(line, '{C.BULLET}', '')) AS line FROM (SELECT doc_id, {S.BULLETED} AS line FROM documents)")
def fn_strip_bullet(spark, d):
    rows = S.table(spark, d, "documents").selectExpr("doc_id", f"{S.BULLETED} AS line")
    return rows.select("doc_id", C.strip_bullet(F.col("line")).alias("line"))


_STATE = "last_value(CASE WHEN contains(lower(line), 'the') THEN 'responsibilities' WHEN contains(lower(line), 'der') THEN 'requirements' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no)"


# -- scores ---------------------------------------------------------------------------------------------

_STATED = "CASE id % 8 WHEN 0 THEN '51job_batch' WHEN 1 THEN 'jobsdb_batch' WHEN 2 THEN 'liepin_batch' WHEN 3 THEN 'smart_collector' WHEN 4 THEN 'crawler' WHEN 5 THEN 'manual' WHEN 6 THEN 'url' ELSE 'else' END"
_TRUST = "CASE s " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in P.AUTHORITY.items()) + f" ELSE {P.OTHER_AUTHORITY} END"
_BODY = "CASE id % 9 WHEN 0 THEN '请先登录' WHEN 1 THEN 'Please VERIFY: ' || raw_text WHEN 2 THEN raw_text || repeat('x', 3000) ELSE raw_text END"
_WORDS = " OR ".join(f"contains(lower(coalesce(title, '') || chr(10) || coalesce(company, '') || chr(10) || coalesce(body, '')), '{w.lower()}')" for w in T.ANTI_BOT)
_CRAWL = ", ".join(f"'{c}'" for c in T.CRAWLED)
_TITLES = ", ".join(f"'{t}'" for t in T.WALL_TITLES)
_SUB2 = f"""SELECT *, s IN ({_CRAWL}) AND ({_WORDS}) AND (length({_stripped("coalesce(body, '')")}) < 300 OR trim(coalesce(title, '')) = '' OR trim(coalesce(company, '')) = '' OR trim(title) IN ({_TITLES}) OR position_tag IS NULL) AS garbage,
  round(least(1, CASE WHEN id % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.10 ELSE 0 END + CASE WHEN n_tags > 0 THEN 0.20 + least(0.20, n_tags * 0.04) ELSE 0 END + CASE WHEN industry_tag <> '' THEN 0.20 ELSE 0 END)::DOUBLE, 4) AS parsed,
  CASE WHEN deleted_at IS NOT NULL THEN 0 ELSE {_TRUST} END::DOUBLE AS trusted, CASE WHEN id % 10 = 3 THEN 0.5 ELSE round(1 / (1 + exp((greatest(0, (epoch_us({NOW}) - epoch_us(crawled_at)) / 86400000000) - 90) / 30)), 4) END::DOUBLE AS fresh,
  CASE WHEN length(trim(body)) < 200 THEN 0.2 WHEN length(trim(body)) < 500 THEN 0.4 WHEN length(trim(body)) < 1500 THEN 0.7 WHEN length(trim(body)) < 3500 THEN 0.9 ELSE 1.0 END::DOUBLE AS rich FROM (SELECT *, {_STATED} AS s, {_BODY} AS body FROM jds)"""


@query("jd_quality", f"SELECT id, parsed, trusted, fresh, rich, garbage, CASE WHEN garbage THEN least(0.2::DOUBLE, raw) ELSE round(raw, 4) END AS composite FROM (SELECT *, 0.35::DOUBLE * parsed + 0.25::DOUBLE * round(trusted, 4) + 0.2::DOUBLE * fresh + 0.2::DOUBLE * rich AS raw FROM ({_SUB2}))", ("jds",))
def jd_quality(spark, d):
    """Sub-scores and quality of a posting: how much is structured, its source, its age and length; garbage is capped."""
    rows = S.jds(spark, d).withColumns({"source": F.expr(_STATED), "raw_text": F.expr(_BODY), "crawled_at": F.when(F.col("id") % 10 != 3, F.col("crawled_at"))})
    rows = rows.select(
        "id", F.round(P.completeness(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("n_tags"), F.col("industry_tag")), 4).alias("parsed"), P.authority(F.col("source"), F.col("deleted_at")).alias("trusted"),
        P.freshness(F.col("crawled_at"), S.as_of()).alias("fresh"), P.richness(F.col("raw_text")).alias("rich"), T.is_garbage("source", "title", "company", "raw_text", F.col("position_tag")).alias("garbage"),
    )
    return rows.select("*", P.composite(*[F.col(c) for c in ("parsed", "trusted", "fresh", "rich", "garbage")]).alias("composite"))


def resumes(spark, d):
    """Resumes with nested sections, from customers and their orders."""
    entry = F.struct(
        F.when(F.col("o_orderkey") % 4 > 0, "x").alias("company"), F.when(F.col("o_orderkey") % 3 > 0, "t").alias("title"), F.when(F.col("o_orderkey") % 4 > 0, "n").alias("name"), F.when(F.col("o_orderkey") % 3 > 0, "r").alias("role"),
        F.repeat(F.lit("d"), (F.col("o_orderkey") % 60).cast("int")).alias("description"), F.array_repeat(F.lit("a"), (F.col("o_orderkey") % 3).cast("int")).alias("achievements"),
    )
    nested = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(entry).alias("experience"), F.collect_list(F.when(F.col("o_orderstatus") == "F", entry)).alias("projects"))
    school = F.struct(F.lit("s").alias("school"), F.lit("d").alias("degree"), F.lit("").alias("major"), F.lit(2000).alias("start_year"), F.lit(2004).alias("end_year"))
    rows = S.table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "cast(c_custkey % 6 AS int) AS n_achievements", "cast(c_custkey % 9 AS int) AS n_skills", "cast(c_custkey % 3 AS int) AS n_education")
    rows = rows.join(nested, "id", "left").withColumn("education", F.array_repeat(school, F.col("n_education")))
    none = F.array().cast(nested.schema["experience"].dataType)
    return rows.withColumns({"experience": F.coalesce("experience", none), "projects": F.coalesce("projects", none)})


_SEG = """SELECT c_custkey AS id, c_custkey % 6 AS na, c_custkey % 9 AS ns, c_custkey % 3 AS ne, coalesce(e.p, 0) AS ep, coalesce(e.n, 0) AS en, coalesce(e.q, 0) AS pp, coalesce(e.m, 0) AS pn, coalesce(e.el, 0) AS el, coalesce(e.pl, 0) AS pl FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, sum(a + b + CASE WHEN o_orderkey % 60 >= 30 THEN 7.5 ELSE 0 END + c) AS p, count(*) FILTER (WHERE f) AS m, sum(a + b + CASE WHEN o_orderkey % 60 >= 20 THEN 7.5 ELSE 0 END + c) FILTER (WHERE f) AS q, sum(l) AS el, sum(l) FILTER (WHERE f) AS pl
  FROM (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS f, CASE WHEN o_orderkey % 4 > 0 THEN 7.5 ELSE 0 END::DOUBLE AS a, CASE WHEN o_orderkey % 3 > 0 THEN 7.5 ELSE 0 END::DOUBLE AS b, CASE WHEN o_orderkey % 3 > 0 THEN 7.5 ELSE 0 END::DOUBLE AS c, 1 + greatest(1, ceil(o_orderkey % 60 / 30)) + o_orderkey % 3 AS l FROM orders) GROUP BY o_custkey) e ON e.o_custkey = c_custkey"""
_INFO = "CASE WHEN en > 0 THEN ep / (en * 30) * 100 ELSE 0 END * 0.35::DOUBLE + CASE WHEN pn > 0 THEN pp / (pn * 30) * 100 ELSE 0 END * 0.25::DOUBLE + CASE WHEN ne > 0 THEN 80 ELSE 0 END * 0.15::DOUBLE + least(na * 25, 100) * 0.15::DOUBLE + least(ns * 20, 100) * 0.10::DOUBLE"


@query("resume_information_score", f"SELECT id, round(s, 3) AS score, CASE WHEN s >= 70 THEN 'A' WHEN s >= 40 THEN 'A+B' ELSE 'B' END AS mode FROM (SELECT id, round({_INFO}, 6) AS s FROM ({_SEG}))")
def resume_information_score(spark, d):
    s = F.round(P.information(F.col("experience"), F.col("projects"), F.col("education"), F.col("n_achievements"), F.col("n_skills")), 6)
    return resumes(spark, d).select("id", F.round(s, 3).alias("score"), P.mode(s).alias("mode"))


_MM = "12.0 + ((ne > 0)::INT + (el > 0)::INT + (pl > 0)::INT + 1 + (na > 0)::INT) * 6.5 + (ne + greatest(1, (ns + 8) // 8)) * 4.5 + (el + pl + na) * 4.8"


@query("one_page_estimate", f"SELECT id, CAST(el AS INTEGER) AS experience, CAST(pl AS INTEGER) AS projects, CAST(2 + ne + el + pl + greatest(1, (ns + 8) // 8) + na AS INTEGER) AS total_lines, round(({_MM})::DOUBLE, 2) AS total_mm, ({_MM})::DOUBLE > 265 AS overflow FROM ({_SEG})")
def one_page_estimate(spark, d):
    page = P.page(F.lit(3), F.col("experience"), F.col("projects"), F.col("n_education"), F.col("n_achievements"), F.col("n_skills"))
    return resumes(spark, d).select("id", page.alias("p")).select("id", "p.experience", "p.projects", "p.total_lines", "p.total_mm", "p.overflow")


_JOB = "['Brand#1', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13']"


def job():
    return F.array(*[F.lit(f"Brand#{n}") for n in (1, 10, 11, 12, 13)])


@query("rule_match", f"SELECT user_id, score, score >= 70 AS apply FROM (SELECT user_id, CAST(CASE WHEN n_orders >= 12 THEN least(b + 10, 100) WHEN n_orders < 8 THEN greatest(b - 10, 0) ELSE b END AS INTEGER) AS score FROM (SELECT user_id, n_orders, floor(len(list_intersect(skills, {_JOB})) / 5 * 100) AS b FROM skills))", ("skills",))
def rule_match(spark, d):
    years = F.when(F.col("n_orders") >= 12, 3).when(F.col("n_orders") < 8, 0).otherwise(2)
    return S.skills(spark, d).select("user_id", P.rule_score(F.col("skills"), job(), years).alias("score")).withColumn("apply", F.col("score") >= 70)


_SHARED = "SELECT r.id AS resume_id, j.id AS job_id, any_value(r.years) AS years, any_value(j.skills) AS wants, list_sort(list(s)) AS matched FROM (SELECT id, years, unnest(skills) AS s FROM low_people) r JOIN (SELECT id, skills, unnest(skills) AS s FROM low_jobs) j USING (s) GROUP BY ALL"
_LOW = "low_{0} AS (SELECT * REPLACE (list_distinct(list_transform(skills, lambda x: lower(x))) AS skills) FROM {0})"


@query("match_pairs", f", {_LOW.format('people')}, {_LOW.format('jobs')} SELECT resume_id, job_id, score, matched, list_sort(list_filter(wants, lambda x: NOT list_contains(matched, x))) AS missing FROM (SELECT *, CAST(greatest(0, least(100, floor(len(matched) / len(wants) * 100) + CASE WHEN years >= 3 THEN 10 WHEN years < 1 THEN -10 ELSE 0 END)) AS INTEGER) AS score FROM ({_SHARED})) WHERE score >= 70", ("people", "jobs"))
def match_pairs(spark, d):
    """Every resume and job that reach the score to apply, with what is there and what is missing."""
    return matching.matches(S.people(spark, d), S.jobs(spark, d))


@query("simple_match", f"SELECT user_id, round(least(1, len(list_intersect(skills, {_JOB})) / 5 * 0.4 + 0.3 + 0.2 + 0.1), 6) AS score FROM skills", ("skills",))
def simple_match(spark, d):
    return S.skills(spark, d).select("user_id", F.round(P.simple_score(F.col("skills"), job()), 6).alias("score"))


@query("fact_check", "SELECT user_id, list_filter(['brand#1', 'Brand#25', 'brand#99'], lambda s: len(list_filter(skills, lambda t: contains(lower(t), lower(s)))) > 0) AS confirmed, least(100, greatest(0, CAST(n_orders AS INTEGER) * 20 - 50)) AS score FROM skills", ("skills",))
def fact_check(spark, d):
    claimed = F.array(*[F.lit(x) for x in ("brand#1", "Brand#25", "brand#99")])
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.col("n_orders").cast("int") * 20 - 50))
    return S.skills(spark, d).select("user_id", P.confirmed_skills(claimed, F.col("skills")).alias("confirmed"), score.alias("score"))


@query("profile_confidence", f"SELECT id, CAST(15 + CASE WHEN id % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN ns > 0 THEN 20 ELSE 0 END + CASE WHEN en > 0 THEN 10 ELSE 0 END + CASE WHEN ne > 0 THEN 15 ELSE 0 END + CASE WHEN pn > 0 THEN 15 ELSE 0 END AS INTEGER) AS confidence FROM ({_SEG})")
def profile_confidence(spark, d):
    c = P.confidence(F.col("name"), F.when(F.col("id") % 2 == 0, "p"), F.when(F.col("id") % 3 == 0, "e"), F.col("n_skills"), F.size("experience"), F.col("n_education"), F.size("projects"))
    return resumes(spark, d).select("id", c.alias("confidence"))
