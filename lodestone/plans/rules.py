"""Rules over the texts of postings, resumes and parsed documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks as B
from ..functions import postings as P
from ..functions import text as T
from ..operators import scoring
from ..sources import frames as S
from .registry import query

WS = r"[ \t\n\x0b\f\r]"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def texts(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def once(rows: str, column: str, most: int) -> str:
    """``rows`` with the list of ``column`` without repetitions, in order, cut."""
    return f"SELECT * REPLACE (list_filter({column}, lambda x, i: list_position({column}, x) = i)[1:{most}] AS {column}) FROM ({rows})"


def postings(spark, d):
    return S.spread(S.table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS id", f"{S.POSTING} AS text")


_ALL = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in P.SKILL_PATTERNS) + ")"
_WANTED = "list_concat(" + ", ".join(f"regexp_extract_all(CASE WHEN strpos(text, '{m}') > 0 THEN substr(text, strpos(text, '{m}'), 200) ELSE '' END, '({P.W}{{2,8}})', 1)" for m in P.WANTED_MARKS) + ")"


@query("fn_extract_skills_regex", once(once(f"SELECT id, {_ALL} AS skills, {_WANTED} AS wanted FROM postings", "skills", 20), "wanted", 10), ("postings",))
def fn_extract_skills_regex(spark, d):
    """Ten patterns in order, and the words after marks of what is nice to have."""
    return postings(spark, d).select("id", P.skills_by_rule(F.col("text")).alias("skills"), P.wanted_skills(F.col("text")).alias("wanted"))


def _labelled(name: str) -> str:
    labels, default = P.LABELS[name]
    tries = [f"nullif({strip(rf"regexp_extract(text, '(?i){x}[：:]\s*(.+?)(?:\n|$)', 1)")}, '')" for x in labels]
    if name == "title":
        tries.append(f"list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: {strip('x')}), lambda x: x <> '' AND length(x) < 50)[1]")
    return f"coalesce({', '.join(tries)}, '{default}') AS {name}"


@query("fn_extract_field", f"SELECT id, {', '.join(map(_labelled, P.LABELS))} FROM postings", ("postings",))
def fn_extract_field(spark, d):
    """Title, company, location and salary by their labels, with defaults."""
    return postings(spark, d).select("id", *[P.labelled(F.col("text"), n).alias(n) for n in P.LABELS])


_TECH = texts(dict.fromkeys(w for words in P.TECH_WORDS.values() for w in words))
_DASHES = rf"list_filter(list_transform(regexp_extract_all(section, '-\s*(.+?)(?:\n|$)', 1), lambda x: {strip('x')}), lambda x: length(x) > {{}})"


def _zh(mark: str) -> str:
    rest = f"(CASE WHEN strpos(text, '{mark}') > 0 THEN substr(text, strpos(text, '{mark}') + {len(mark)}) ELSE '' END)"
    ends = "[" + ", ".join(f"strpos({rest}, '{c}')" for c in P.SECTION_CLOSES) + "]"
    return strip(f"substr({rest}, 1, coalesce(list_min(list_filter({ends}, lambda z: z > 0)) - 1, length({rest})))")


def _first(sections: list[str], items: str, most: int) -> str:
    """id and the items of the first section that has any."""
    listed = f"SELECT id, unnest(range(0, {len(sections)})) AS k, unnest([{', '.join(sections)}]) AS section FROM postings"
    return f"SELECT id, coalesce(arg_min(items, k) FILTER (WHERE len(items) > 0), []) AS items FROM ({once(f'SELECT id, k, {items} AS items FROM ({listed})', 'items', most)}) GROUP BY id"


_CORE = _first([*[f"regexp_extract(text, '{p}', 1)" for p in P.ENGLISH_SECTIONS], *map(_zh, P.SECTION_OPENS)], f"list_concat(list_filter({_TECH}, lambda w: contains(lower(section), lower(w))), {_DASHES.format(5)})", 10)
_NUMBERED = rf"list_filter(list_transform(regexp_extract_all(section, '[一二三四五六七八九十\d][\.、]\s*(.+?)(?:\n|$)', 1), lambda x: {strip('x')}), lambda x: length(x) > 3)"
_PREFERRED = _first([f"regexp_extract(text, '{p}', 1)" for p in P.PREFERRED_SECTIONS], f"list_concat({_NUMBERED}, {_DASHES.format(3)})", 5)
_TRAITS = "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN len(list_filter({texts(w)}, lambda w: contains(lower(text), lower(w)))) > 0 THEN '{n}: ' || array_to_string(list_filter({texts(w)}, lambda w: contains(lower(text), lower(w))), ', ') END" for n, w in P.TRAIT_WORDS.items()) + "], lambda x: x IS NOT NULL), chr(10)), '')"


@query("fn_extract_requirements", f"SELECT p.id, c.items AS required, w.items AS preferred, coalesce({_TRAITS}, '{P.NO_TRAITS}') AS traits FROM postings p JOIN ({_CORE}) c ON c.id = p.id JOIN ({_PREFERRED}) w ON w.id = p.id", ("postings",))
def fn_extract_requirements(spark, d):
    """What a posting requires and prefers, from its sections, and the traits that it hints at."""
    t = F.col("text")
    return postings(spark, d).select("id", P.requirements(t).alias("required"), P.preferred(t).alias("preferred"), P.traits(t).alias("traits"))


def _marked(marks) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{m}')" for m in marks) + ")"


_ITEM = strip(f"regexp_replace(x, '{P.BULLET}', '')")
_STATES = f"""SELECT id, i, mark, CASE WHEN regexp_matches(x, '{P.BULLET}') THEN {_ITEM} ELSE '' END AS item, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY i), 'duty') AS state
  FROM (SELECT *, CASE WHEN {_marked(P.DUTY_MARKS)} THEN 'duty' WHEN {_marked(P.NEED_MARKS)} THEN 'need' END AS mark FROM (SELECT id, i, {strip('x')} AS x FROM (SELECT id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT id, string_split(text, chr(10)) AS l FROM postings))) WHERE x <> '')"""


@query("fn_split_resp_req", f"SELECT id, coalesce(list(item ORDER BY i) FILTER (WHERE mark IS NULL AND item <> '' AND state = 'duty'), []) AS responsibilities, coalesce(list(item ORDER BY i) FILTER (WHERE mark IS NULL AND item <> '' AND state = 'need'), []) AS requirements FROM ({_STATES}) GROUP BY id", ("postings",))
def fn_split_resp_req(spark, d):
    """Bulleted lines belong to the last heading before them."""
    return postings(spark, d).select("id", P.duties_and_needs(F.col("text")).alias("s")).select("id", "s.*")


_URL = r"regexp_extract(x, '(https?://[^\s|]+/job/\d+\.s?html)', 1)"


@query("fn_parse_line_records", rf"""SELECT page_id, url, coalesce(nullif(regexp_extract(url, '/job/(\d+)', 1), ''), replace(regexp_extract(url, '([^/]*)$', 1), '.html', '')) AS job, title, {strip(r"regexp_extract(x, '公司[：:]\s*([^\n|]{2,40})', 1)")} AS company
  FROM (SELECT *, substr({strip("split_part(x, url, 1)")}, 1, 120) AS title FROM (SELECT page_id, x, {_URL} AS url FROM (SELECT page_id, {strip(S.RESULT_LINE)} AS x FROM pages) WHERE length(x) >= 5 AND NOT ({" OR ".join(f"contains(x, '{w}')" for w in P.NO_POSTING)})) WHERE url <> '') WHERE length(title) > 2""")
def fn_parse_line_records(spark, d):
    """Lines of a results page that name a posting."""
    lines = S.table(spark, d, "pages").selectExpr("page_id", f"{S.RESULT_LINE} AS line")
    return lines.select("page_id", P.line_record(F.col("line")).alias("r")).where("r is not null").select("page_id", "r.*")


_BARE = strip(r"regexp_replace(title, '\([^)]*\)', '', 'g')")


@query("fn_query_forms", rf"""SELECT id, coalesce(nullif({strip('substr(bare, 1, 25)')}, ''), substr(title, 1, 25)) AS short, CASE WHEN s <> '' AND NOT contains(bare, s) THEN {strip("substr(bare || ' ' || s, 1, 60)")} ELSE substr(bare, 1, 50) END AS medium, {strip("substr(bare || ' 岗位，要求' || h, 1, 120)")} AS long
  FROM (SELECT id, title, {_BARE} AS bare, substr({strip(r"regexp_extract(raw_text, '^([^。\n\.!?;]*)', 1)")}, 1, 30) AS s, {strip("substr(replace(raw_text, chr(10), ' '), 1, 80)")} AS h FROM (SELECT id, CASE WHEN id % 3 = 0 THEN title || ' (Remote)' WHEN id % 3 = 1 THEN '(x)' ELSE title END AS title, raw_text FROM jds))""", ("jds",))
def fn_query_forms(spark, d):
    rows = S.jds(spark, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN title || ' (Remote)' WHEN id % 3 = 1 THEN '(x)' ELSE title END AS title", "raw_text")
    return rows.select("id", P.query_forms(F.col("title"), F.col("raw_text")).alias("q")).select("id", "q.*")


# -- resumes ------------------------------------------------------------------------------------------------

_HEADS = " UNION ALL ".join(f"SELECT id, '{n}' AS section, min(i) AS first_line FROM l WHERE length(x) < {P.HEADING_CHARS} AND ({' OR '.join(f"contains(lower(x), '{w}')" for w in dict.fromkeys(words))}) GROUP BY id" for n, words in P.RESUME_SECTIONS.items())


@query("fn_resume_sections", f"WITH r AS (SELECT c_custkey AS id, string_split({S.RESUME}, chr(10)) AS a FROM customer), l AS (SELECT id, unnest(range(0, len(a))) AS i, unnest(a) AS x FROM r), h AS ({_HEADS}) SELECT h.id, h.section, CAST(h.first_line AS INTEGER) AS first_line, CAST(coalesce((SELECT min(o.first_line) FROM h o WHERE o.id = h.id AND o.first_line > h.first_line), len(r.a)) - h.first_line - 1 AS INTEGER) AS n_lines FROM h JOIN r ON r.id = h.id")
def fn_resume_sections(spark, d):
    """Heading line of each section of a resume, and the lines up to the next section."""
    rows = S.table(spark, d, "customer").selectExpr("c_custkey AS id", f"{S.RESUME} AS text")
    return rows.select("id", F.inline(P.resume_sections(F.col("text"))))


def _named(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in tests) + "], lambda x: x IS NOT NULL)"


def _blank(x: str) -> str:
    return f"trim(coalesce({x}, '')) = ''"


_NE = "coalesce(len(experience), 0)"
_TESTS = [(f"({_blank('name')} OR name = 'Unknown')", "姓名", "未找到姓名信息"), (_blank("email"), "邮箱", "未找到邮箱地址"), (_blank("phone"), None, "未找到电话号码"), (f"{_NE} = 0", "工作经历", "未找到工作经历"), ("n_skills = 0", "技能", "未找到技能信息"), ("n_education = 0", "教育背景", "未找到教育背景")]


@query("fn_completeness", f"SELECT id, greatest(0, (5 - len(missing)) / 5.0)::DOUBLE AS score, (5 - len(missing)) / 5.0 >= 0.8 AS complete, missing, issues FROM (SELECT id, {_named([(c, m) for c, m, _ in _TESTS if m])} AS missing, {_named([(c, i) for c, _, i in _TESTS])} AS issues FROM cvs)", ("cvs",))
def fn_completeness(spark, d):
    n = F.coalesce(F.size("experience"), F.lit(0))
    found = P.completeness(F.col("name"), F.col("email"), F.col("phone"), n, F.col("n_skills"), F.col("n_education"))
    return S.cvs(spark, d).select("id", found.alias("c")).select("id", "c.*")


_ISSUES = _named([(f"({_blank('name')} OR name = '未知')", "姓名缺失"), (_blank("email"), "邮箱缺失"), ("n_skills = 0", "技能列表为空"), ("years < 0", "工作年限异常")])


@query("fn_profile_validate", f"SELECT id, (10 - len(issues)) / 10.0::DOUBLE AS score, (10 - len(issues)) / 10.0 >= 0.7 AS valid, issues FROM (SELECT id, {_ISSUES} AS issues FROM cvs)", ("cvs",))
def fn_profile_validate(spark, d):
    return S.cvs(spark, d).select("id", P.profile_check(F.col("name"), F.col("email"), F.col("n_skills"), F.col("years")).alias("c")).select("id", "c.*")


def _lacks(section: str, none: str, before: str, after: str) -> str:
    has = lambda f: f"len(list_filter(e.{f}, lambda v: trim(v) <> '')) = 0" if f in ("achievements", "tech_stack") else _blank(f"e.{f}")
    labels = "list_filter([" + ", ".join(f"CASE WHEN {has(f)} THEN '{before}' || i || '{after}：{label}' END" for f, label in P.REQUIRED_FIELDS[section]) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN coalesce(len({section}), 0) = 0 THEN ['{none}'] ELSE flatten(list_transform({section}, lambda e, i: {labels})) END"


@query("fn_section_validation", f"SELECT id, {_lacks('experience', '至少 1 段工作经历', '第 ', ' 段工作经历')} AS experience, {_lacks('projects', '至少 1 段项目', '第 ', ' 个项目')} AS projects FROM cvs", ("cvs",))
def fn_section_validation(spark, d):
    """Required fields that entries of a section lack, labelled with the entry's number."""
    return S.cvs(spark, d).select("id", *[P.lacking(F.col(s), s).alias(s) for s in ("experience", "projects")])


_SAYS = "coalesce(len(list_filter({0}, lambda e: trim(coalesce(e.{1}, '')) <> '' OR trim(coalesce(e.{2}, '')) <> '')), 0) = 0"


@query("fn_detect_empty_sections", f"SELECT id, {_named([(_SAYS.format('experience', 'company', 'description'), 'experience'), (_SAYS.format('projects', 'name', 'description'), 'projects'), ('n_achievements = 0', 'achievements')])} AS empty FROM cvs", ("cvs",))
def fn_detect_empty_sections(spark, d):
    return S.cvs(spark, d).select("id", P.empty_sections(F.col("experience"), F.col("projects"), F.array_repeat(F.lit("a"), F.col("n_achievements"))).alias("empty"))


@query("validate_row", f"""SELECT id, coalesce(salary_min > salary_max, false) AS salary_reversed, source NOT IN ('src0', 'src1', 'src2') AS bad_platform, coalesce(quality_score * 100 NOT BETWEEN 0 AND 90, false) AS bad_score,
  {_named([("coalesce(NOT (contains(email, '@') AND contains(split_part(email, '@', -1), '.')), true)", "email"), ("coalesce(NOT regexp_matches(regexp_replace(phone, '[ -]', '', 'g'), '^[0-9]{11,}$'), true)", "phone")])} AS bad_contact
  FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' || id || '@b.c' ELSE 'a@b@c' END AS email, CASE WHEN id % 4 = 0 THEN '138 0000-' || (1000 + id % 9000) WHEN id % 4 = 1 THEN '12' ELSE 'x' || id END AS phone FROM jds)""", ("jds",))
def validate_row(spark, d):
    """Ranges, names and formats that a row breaks."""
    rows = S.jds(spark, d).selectExpr("*", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' || id || '@b.c' ELSE 'a@b@c' END AS email", "CASE WHEN id % 4 = 0 THEN '138 0000-' || (1000 + id % 9000) WHEN id % 4 = 1 THEN '12' ELSE 'x' || id END AS phone")
    return rows.select("id", F.expr("coalesce(salary_min > salary_max, false) AS salary_reversed"), (~F.col("source").isin("src0", "src1", "src2")).alias("bad_platform"), F.coalesce(~(F.col("quality_score") * 100).between(0, 90), F.lit(False)).alias("bad_score"), P.contact_issues(F.col("email"), F.col("phone")).alias("bad_contact"))


_PAY = "CASE id % 5 WHEN 0 THEN salary_min || 'K-' || coalesce(salary_max, 99) || 'K' WHEN 1 THEN salary_min || 'K' WHEN 2 THEN 'by agreement' WHEN 3 THEN '' ELSE 'from ' || salary_min || ' to ' || coalesce(salary_max, 12) END"
_PLACE = "CASE id % 3 WHEN 0 THEN 'Shanghai' WHEN 1 THEN 'remote, SHANGHAI area' ELSE 'Berlin' END"


@query("filter_criteria", f"""SELECT id, low, high, place FROM (SELECT id, place, coalesce(try_cast(regexp_extract(pay, '([0-9]+)[^0-9]+([0-9]+)', 1) AS INTEGER), try_cast(regexp_extract(pay, '([0-9]+)', 1) AS INTEGER)) AS low, coalesce(try_cast(regexp_extract(pay, '([0-9]+)[^0-9]+([0-9]+)', 2) AS INTEGER), try_cast(regexp_extract(pay, '([0-9]+)', 1) AS INTEGER)) AS high
  FROM (SELECT id, {_PAY} AS pay, {_PLACE} AS place FROM jds)) WHERE low >= 8 AND high <= 30 AND contains(lower(place), 'shanghai')""", ("jds",))
def filter_criteria(spark, d):
    """Salaries are read from text; rows without one don't pass a bound."""
    rows = S.jds(spark, d).selectExpr("id", f"{_PAY} AS pay", f"{_PLACE} AS place").select("id", "place", T.salary_range(F.col("pay")).alias("s"))
    return rows.where((F.col("s.low") >= 8) & (F.col("s.high") <= 30) & F.lower("place").contains("shanghai")).select("id", "s.low", "s.high", "place")


_GPAS = "[CASE WHEN id % 5 = 0 THEN 2.5::DOUBLE WHEN id % 5 = 1 THEN 3.5::DOUBLE END, CASE WHEN id % 4 = 0 THEN 2.75::DOUBLE END]"


@query("one_page_suggestions", f"""SELECT id, list_concat(
    CASE WHEN len(low) > 0 THEN ['GPA ' || low[1] || ' 低于 3.0，建议删除 GPA 字段'] ELSE [] END,
    list_transform(list_filter(coalesce(list_transform(experience, lambda e: e.duration), []), lambda m: m IS NOT NULL AND CAST(regexp_extract(m, '([0-9]+)', 1) AS INTEGER) < 3), lambda m: '短期实习（' || m || '）≤ 3 月，建议合并或删除'),
    ['重复技能 ' || CASE WHEN id % 3 = 0 THEN 'Go' ELSE 'SQL' END || ' 出现 ≥ 3 次，可去重']) AS suggestions FROM (SELECT *, list_filter({_GPAS}, lambda g: g < 3) AS low FROM cvs)""", ("cvs",))
def one_page_suggestions(spark, d):
    """What to leave out of a resume that exceeds a page."""
    i = F.col("id")
    gpas = F.array(F.when(i % 5 == 0, 2.5).when(i % 5 == 1, 3.5), F.when(i % 4 == 0, 2.75))
    skills = F.array(F.when(i % 3 == 0, "Go").otherwise("SQL"), *[F.lit(x) for x in ("SQL", "SQL", "Go", "Go")])
    return S.cvs(spark, d).select("id", scoring.suggestions(gpas, F.col("experience.duration"), skills, F.array().cast("array<string>")).alias("suggestions"))


# -- blocks of documents ------------------------------------------------------------------------------------

_FONTS = "CASE p_partkey % 4 WHEN 0 THEN 'arial' WHEN 1 THEN 'times-semibold' WHEN 2 THEN 'BoldSans' ELSE 'serif' END"


@query("fn_classify_heading", f"""SELECT id, CAST(CASE WHEN x = '' THEN 0 {" ".join(f"WHEN regexp_matches(x, '{p}') THEN {n}" for p, n in B.NUMBERINGS)} WHEN size > 14 AND length(x) < 80 THEN 1 WHEN contains(font, 'bold') AND length(x) < 100 THEN 1 ELSE 0 END AS INTEGER) AS level
  FROM (SELECT p_partkey AS id, {strip(S.HEADED)} AS x, p_partkey % 17 AS size, {_FONTS} AS font FROM part)""")
def fn_classify_heading(spark, d):
    """Heading levels by numbering, size and weight of the font."""
    rows = S.table(spark, d, "part").selectExpr("p_partkey AS id", f"{S.HEADED} AS text", "p_partkey % 17 AS size", f"array({_FONTS}, 'x') AS fonts")
    return rows.select("id", B.heading(F.col("text"), F.col("size"), F.col("fonts")).alias("level"))


def listings(spark, d):
    return S.spread(S.table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS id", f"{S.LISTING} AS text")


def spans(text):
    return F.transform(F.split(text, "\n"), lambda x: F.filter(F.split(x, r"\|"), lambda c: F.trim(c) != ""))


_SPANS = "list_transform(string_split(text, chr(10)), lambda x: list_filter(string_split(x, '|'), lambda c: trim(c) <> ''))"


@query("fn_looks_like_list", rf"""SELECT id, len(l) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•\d+)]\s+'))) / len(l) > 0.5 AS list,
  len(s) >= 2 AND len(n) > 0 AND (len(list_distinct(n)) = 1 AND n[1] >= 2 OR len(s[1]) >= 2 OR len(s[2]) >= 2) AS table_ FROM (SELECT *, list_filter(list_transform(s, lambda x: len(x)), lambda x: x > 0) AS n FROM (SELECT id, string_split({strip('text')}, chr(10)) AS l, {_SPANS} AS s FROM listings))""", ("listings",))
def fn_looks_like_list(spark, d):
    return listings(spark, d).select("id", B.looks_like_list(F.col("text")).alias("list"), B.looks_like_table(spans(F.col("text"))).alias("table_"))


_ROW = "'| ' || array_to_string(list_concat(r, list_transform(range(0, w - len(r)), lambda z: '')), ' | ') || ' |'"


@query("fn_block_to_markdown", f"SELECT id, CASE WHEN len(rows) = 0 THEN '' ELSE array_to_string(list_concat([m[1]], ['| ' || array_to_string(list_transform(range(0, w), lambda z: '---'), ' | ') || ' |'], m[2:]), chr(10)) END AS table_ FROM (SELECT *, list_transform(rows, lambda r: {_ROW}) AS m FROM (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM (SELECT id, list_filter(list_transform({_SPANS}, lambda x: list_transform(x, lambda c: trim(c))), lambda r: len(r) > 0) AS rows FROM listings)))", ("listings",))
def fn_block_to_markdown(spark, d):
    """Spans of lines as a Markdown table with a header and padded rows."""
    return listings(spark, d).select("id", B.markdown(spans(F.col("text"))).alias("table_"))


@query("scan_pdf_blocks", rf"""SELECT id, CAST(block AS INTEGER) AS block, CASE WHEN len(s) >= 2 AND len(n) > 0 AND (len(list_distinct(n)) = 1 AND n[1] >= 2 OR len(s[1]) >= 2 OR len(s[2]) >= 2) THEN 'table'
    WHEN regexp_matches(x, '{B.NUMBERINGS[0][0]}') OR regexp_matches(x, '{B.NUMBERINGS[1][0]}') OR regexp_matches(x, '{B.NUMBERINGS[2][0]}') OR regexp_matches(x, '{B.NUMBERINGS[3][0]}') OR regexp_matches(x, '{B.NUMBERINGS[4][0]}') OR regexp_matches(x, '{B.NUMBERINGS[5][0]}') OR block = 0 AND length(x) < 80 THEN 'heading'
    WHEN len(l) >= 2 AND len(list_filter(l, lambda z: regexp_matches(z, '^\s*[-*•\d+)]\s+'))) / len(l) > 0.5 THEN 'list' ELSE 'paragraph' END AS kind
  FROM (SELECT *, string_split(x, chr(10)) AS l, list_filter(list_transform(s, lambda z: len(z)), lambda z: z > 0) AS n FROM (SELECT id, block, {strip('text')} AS x, {_SPANS} AS s FROM (SELECT id, unnest(range(0, len(b))) AS block, unnest(b) AS text FROM (SELECT p_partkey AS id, [{S.HEADED}, {S.LISTING}, p_type] AS b FROM part)))) WHERE x <> ''""")
def scan_pdf_blocks(spark, d):
    """Kinds of a document's text blocks: tables, headings (the first block has a large font), lists, paragraphs."""
    rows = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.expr(S.HEADED), F.expr(S.LISTING), F.col("p_type"))).alias("block", "text")).where(T.strip(F.col("text")) != "")
    t = F.col("text")
    kind = F.when(B.looks_like_table(spans(t)), "table").when(B.heading(t, F.when(F.col("block") == 0, 20).otherwise(10), F.array(F.lit("serif"))) > 0, "heading").when(B.looks_like_list(t), "list").otherwise("paragraph")
    return rows.select("id", "block", kind.alias("kind"))


def _abstract(x: str, most: int) -> str:
    one = strip(f"coalesce({x}, '')")
    head = f"substr({one}, 1, {most})"
    for mark in (" ", "。", "，"):
        head = f"regexp_replace({head}, '{mark}[^{mark}]*$', '')"
    return f"CASE WHEN length({one}) <= {most} THEN {one} ELSE {strip(head)} || '…' END"


_KIND = "CASE turn % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'other' ELSE 'paragraph' END"
_KINDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.TYPE_LABELS.items()) + " ELSE kind END"
_NEAR = "CASE WHEN {0} IS NULL THEN '{1}' ELSE {2} END"
_BODY = "CASE WHEN turn % 3 = 0 THEN 'short' ELSE text END"


@query("rule_context", f"""SELECT conv_id, turn, CASE WHEN length(a) > 150 THEN CASE WHEN length(b) < 50 THEN c ELSE b END WHEN length(a) < 50 THEN c ELSE a END AS context FROM (
  SELECT conv_id, turn, '[文档类型] ' || role || ' | [章节定位] 位于''' || coalesce(nullif(array_to_string(path, ' / '), ''), '文档首页') || '''，[内容类型] ' || {_KINDS} || '，[上文简介] ' || {_NEAR.format('p', '无上文', _abstract('p', 100))} || '，[下文预告] ' || {_NEAR.format('n', '无下文', _abstract('n', 100))} AS a,
    '[文档类型] ' || role || ' | [章节] ' || coalesce(path[-1], '文档首页') || ' | [类型] ' || {_KINDS} || ' | [上文] ' || {_NEAR.format('p', '无', _abstract('p', 30))} || ' | [下文] ' || {_NEAR.format('n', '无', _abstract('n', 30))} AS b,
    '[文档类型] ' || role || ' | [章节] ' || coalesce(path[-1], '文档首页') || ' | [类型] ' || {_KINDS} || ' | [内容] ' || {_abstract('body', 60)} AS c
  FROM (SELECT *, lag(body) OVER w AS p, lead(body) OVER w AS n FROM (SELECT conv_id, turn, role, {_BODY} AS body, {_KIND} AS kind, CASE WHEN turn % 2 = 0 THEN ['one', role] ELSE [] END AS path FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))""")
def rule_context(spark, d):
    """Context of a chunk from its place, kind and neighbours, of 50 to 150 characters where that can be."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    none = F.array().cast("array<string>")
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(_BODY).alias("body"), F.expr(_KIND).alias("kind"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("one"), F.col("role"))).otherwise(none).alias("path"))
    rows = rows.withColumns({"p": F.lag("body").over(w), "n": F.lead("body").over(w)})
    return rows.select("conv_id", "turn", B.context(F.col("role"), F.col("path"), F.col("kind"), F.col("body"), F.col("p"), F.col("n")).alias("context"))


@query("_detect_language", r"SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '[一-鿿　-〿＀-￯]')) / n > 0.3 THEN 'zh' ELSE 'en' END AS language FROM (SELECT doc_id, text, length(replace(text, ' ', '')) AS n FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '职位 描述' || substr(text, 1, doc_id % 20) WHEN 1 THEN '  ' ELSE text END AS text FROM documents))")
def detect_language_of_pages(spark, d):
    rows = S.table(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN '职位 描述' || substr(text, 1, cast(doc_id % 20 AS int)) WHEN 1 THEN '  ' ELSE text END AS text")
    return rows.select("doc_id", T.non_blank_language(F.col("text")).alias("language"))
