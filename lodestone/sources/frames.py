"""Canonical frames of the store, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The instant that "now" means in every query.
AS_OF = "2024-01-31 00:00:00"


#: Texts as expressions that every SQL engine reads alike: a posting and lines of a list of a part, a
#: resume of a customer, a line of a results page.
POSTING = """CASE p_partkey % 4 WHEN 0 THEN '职位名称：' || p_name WHEN 1 THEN 'Position: ' || p_name WHEN 2 THEN 'Senior ' || p_name ELSE repeat('x', 60) END || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN '公司：' || p_brand || '科技' WHEN 1 THEN 'Company:  ' || p_brand || ' Ltd.' ELSE 'We build things' END || chr(10)
  || CASE p_partkey % 5 WHEN 0 THEN '工作地点：北京' WHEN 1 THEN 'location: ' || p_type ELSE 'remote' END || chr(10)
  || CASE p_partkey % 6 WHEN 0 THEN '薪资：' || (p_partkey % 40) || '-' || (p_partkey % 40 + 9) || 'K' WHEN 1 THEN 'Salary:' || p_size ELSE '' END || chr(10)
  || CASE p_partkey % 2 WHEN 0 THEN '岗位职责：' ELSE 'Responsibilities' END || chr(10)
  || '• 负责' || p_type || '的设计' || chr(10) || '- lead the team of ' || p_brand || chr(10) || '1. 快速学习新技术' || chr(10) || 'no bullet here' || chr(10) || '- ' || chr(10)
  || CASE p_partkey % 4 WHEN 0 THEN '【任职要求】' WHEN 1 THEN 'Requirements:' WHEN 2 THEN 'Qualifications' ELSE '你需要' END || chr(10)
  || '- ' || (p_partkey % 9) || '年以上 Python 或 Java 经验' || chr(10) || '- 精通' || p_name || '，熟悉SQL数据库' || chr(10) || '2) 掌握React框架' || chr(10) || '- ok' || chr(10)
  || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '【加分项】' WHEN 1 THEN 'Preferred Qualifications:' ELSE '优先' END || chr(10)
  || '一、英语流利' || chr(10) || '- Kubernetes and Docker' || chr(10) || '2. ok' || chr(10) || chr(10) || 'End.'"""
LISTING = """CASE p_partkey % 6 WHEN 0 THEN '- ' || p_name || chr(10) || '2 ' || p_type WHEN 1 THEN p_name || ' | ' || p_brand || chr(10) || p_type || ' |' WHEN 2 THEN p_name || chr(10) || '* ' || p_type
  WHEN 3 THEN p_name || '|' || p_type || chr(10) || '' || chr(10) || p_brand || '|' || p_size WHEN 4 THEN p_name || chr(10) || p_brand || ' | ' || p_type || ' | x' ELSE p_name END"""
HEADED = """CASE p_partkey % 9 WHEN 0 THEN '1.2.3.4. ' WHEN 1 THEN '1.2.3.' WHEN 2 THEN '10.2. ' WHEN 3 THEN '7. ' WHEN 4 THEN '（3） ' WHEN 5 THEN 'IV. ' WHEN 6 THEN '  ' ELSE '' END || CASE WHEN p_partkey % 10 = 9 THEN '' ELSE repeat(p_name || ' ', CAST(1 + p_partkey % 8 AS INT)) END"""
RESUME = """c_name || chr(10) || CASE c_custkey % 4 WHEN 0 THEN '工作经历' WHEN 1 THEN 'Work Experience:' WHEN 2 THEN 'My projects' ELSE 'nothing' END || chr(10) || 'a line' || chr(10) || c_mktsegment || chr(10)
  || CASE c_custkey % 3 WHEN 0 THEN '教育背景' WHEN 1 THEN 'EDUCATION' ELSE repeat('education ', 8) END || chr(10) || 'a school' || chr(10)
  || CASE c_custkey % 5 WHEN 0 THEN '专业技能' WHEN 1 THEN 'Technical Skills and projects' ELSE 'more' END || chr(10) || 'Python' || chr(10) || 'SQL'"""
RESULT_LINE = """CASE page_id % 5 WHEN 0 THEN '  Engineer ' || page_id || ' https://jobs.example/job/' || page_id || '.html | 公司：Acme ' || page_id || ' | x' WHEN 1 THEN '登录 https://jobs.example/job/5.html'
  WHEN 2 THEN 'A long title, ' || repeat('very ', 30) || 'https://jobs.example/job/' || page_id || '.shtml' WHEN 3 THEN 'x https://jobs.example/job/7.html' ELSE 'no link ' || page_id END"""
#: Pages of postings at a site, around a page's address and its own markup.
INDEED_PAGE = """CASE page_id % 7 WHEN 0 THEN '<div id="jobdesc">short</div><div class="x jobsec y"><b>' || url || '</b> ' || repeat('duty ', CAST(page_id % 20 AS INT)) || '</div>' WHEN 1 THEN '<div class="big-description"><i>' || url || '</i><!-- <b>no</b> --><i>' || repeat('do ', CAST(10 + page_id % 9 AS INT)) || '</i></div>'
  WHEN 2 THEN '<span itemprop="description">' || repeat('skill ', CAST(page_id % 30 AS INT)) || '</span><p>only <b>a</b> paragraph</p><p> </p><p class="k">two</p>' WHEN 3 THEN '<div id="jobDescriptionText">' || repeat('a line<br>', CAST(page_id % 25 AS INT)) || '</div><pre>x</pre>' WHEN 4 THEN '<p></p><pre>no</pre>' WHEN 5 THEN '<div id="the-description-1">' || url || repeat(' more', 9) || '</div><div class="css-1e7z4o5">' || repeat('z', 60) || '</div>' ELSE html END"""
#: Short texts of a document's number: mixed scripts, salaries, ages of postings, headings, replies of a model.
SCRIPTS = "CASE doc_id % 5 WHEN 0 THEN '产品，经理。' || substr(text, 1, CAST(doc_id % 40 AS INT)) WHEN 1 THEN '、。，' || substr(text, 1, 9) WHEN 2 THEN '' ELSE text END"
PAY_K = "CASE doc_id % 7 WHEN 0 THEN (doc_id % 40) || '-' || (doc_id % 40 + 7) || 'K·14 薪' WHEN 1 THEN (doc_id % 40) || ' K以上' WHEN 2 THEN (doc_id % 40) || 'k以下' WHEN 3 THEN (doc_id % 40) || 'K' WHEN 4 THEN '面议' WHEN 5 THEN (doc_id % 9) || ' - ' || (doc_id % 30) ELSE (doc_id % 40) || '元/天' END"
PAY = "CASE doc_id % 5 WHEN 0 THEN 'US$ ' || (20 + doc_id % 9) || ',' || (100 + doc_id % 900) || ' - ' || (40 + doc_id % 9) || ',000' WHEN 1 THEN (doc_id % 90) || 'K - ' || (doc_id % 90 + 5) || 'k' WHEN 2 THEN '18,500' WHEN 3 THEN 'none' ELSE doc_id || ' a month' END"
AGE = "CASE doc_id % 7 WHEN 0 THEN 'Posted ' || (doc_id % 60) || 'd+ ago' WHEN 1 THEN 'Posted ' || (doc_id % 9) || 'w ago' WHEN 2 THEN 'x Posted yesterday' WHEN 3 THEN 'Posted today' WHEN 4 THEN (doc_id % 30) || 'D  ago' WHEN 5 THEN 'Posted ' || (doc_id % 60) || 'd ago' ELSE 'long ago' END"
HEADLINE = "CASE doc_id % 9 WHEN 0 THEN '- Nice to have:' WHEN 1 THEN '岗位职责：' WHEN 2 THEN '2. Requirements' WHEN 3 THEN 'About us' WHEN 4 THEN 'We negotiate contracts' WHEN 5 THEN '• what you''ll do ' WHEN 6 THEN 'Skills & Experience:' WHEN 7 THEN '加分项' ELSE 'requirements ' || repeat('x', CAST(doc_id % 40 AS INT)) END"
BULLETED = "CASE doc_id % 7 WHEN 0 THEN ' • ' WHEN 1 THEN '- ' WHEN 2 THEN '12. ' WHEN 3 THEN '3) ' WHEN 4 THEN '* ' WHEN 5 THEN '-' ELSE '4、 ' END || replace(substr(text, 1, 30), chr(10), ' ')"
REPLY = "CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'It is ' || props || ' then.' WHEN 2 THEN 'no json' WHEN 3 THEN '```' || chr(10) || ' {\"k\": 3} ' || chr(10) || '``` and {\"k\": 4}' ELSE props END"
#: Metadata of a document, a chat message, a crawled row.
DOC_TITLE = "CASE doc_id % 11 WHEN 0 THEN 'My Resume' WHEN 1 THEN 'CV of A' WHEN 2 THEN '个人简历' WHEN 3 THEN 'JD 12' WHEN 4 THEN 'Job Description' WHEN 5 THEN '招聘 启事' WHEN 6 THEN 'Privacy POLICY' WHEN 7 THEN '规定' WHEN 8 THEN 'Annual REPORT' WHEN 9 THEN '报告' ELSE 'Notes' END"
METADATA = f"CASE doc_id % 6 WHEN 0 THEN '{{\"document_type\": \"memo\"}}' WHEN 1 THEN '{{\"type\": \"last\", \"doc_type\": \"note\"}}' WHEN 2 THEN '{{\"type\": \"\", \"document_title\": \"' || {DOC_TITLE} || '\"}}' WHEN 3 THEN 'not json' WHEN 4 THEN NULL ELSE '{{\"document_title\": \"' || {DOC_TITLE} || '\"}}' END"
MESSAGE = "CASE (conv_id + turn) % 12 WHEN 0 THEN '看看匹配' WHEN 1 THEN 'Match me' WHEN 2 THEN '当前状态' WHEN 3 THEN 'read my.PDF' WHEN 4 THEN '解析简历' WHEN 5 THEN '职位：' || repeat(text, 3) WHEN 6 THEN '职位' WHEN 7 THEN 'Analyze JD' WHEN 8 THEN 'write a Cover Letter' WHEN 9 THEN 'RUN workflow please' WHEN 10 THEN NULL ELSE text END"
CRAWLED_ROW = "CASE doc_id % 4 WHEN 0 THEN 'crawler' WHEN 1 THEN 'jobsdb_batch' WHEN 2 THEN NULL ELSE source END AS source, CASE doc_id % 5 WHEN 0 THEN '登录' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'Engineer' END AS title, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '安全验证 Ltd' ELSE 'Acme' END AS company, CASE doc_id % 3 WHEN 0 THEN ' please VERIFY ' || text WHEN 1 THEN text ELSE ' blocked ' END AS raw_text, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '' ELSE 'p' END AS position_tag"
#: Columns of a resume that was read, from a customer.
CONTACT = """c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 13 = 0 THEN '未知' ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'c' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '.example' WHEN 1 THEN '@nowhere' ELSE '@x.example' END END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '138-0000 ' || (1000 + c_custkey % 9000) ELSE '12-' || c_custkey END AS phone,
  CAST(c_custkey % 5 AS INT) AS n_skills, CAST(c_custkey % 6 - 1 AS INT) AS years, CAST(c_custkey % 2 AS INT) AS n_education, CAST(c_custkey % 3 AS INT) AS n_achievements"""


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task whose rows cost much each.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, key: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt by its key to as many tasks as its rows are worth, one a core at least: a narrow table is
    one small file, which one task would read alone. The count comes from the files' footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


#: Rows of a task that sorts narrow rows.
SORTED_ROWS = 1_000_000


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings: one for each document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "concat('u', doc_id % 7) AS user_id", "concat('http://x.example/job/', doc_id % 400, '?p=1#top') AS url",
        "substr(split_part(text, '\\n', 1), 1, 60) AS title", "concat('c', doc_id % 23) AS company", "text AS raw_text", "source", "lang AS language",
        "source AS industry_tag", "lang AS function_tag", "concat('p', doc_id % 5) AS position_tag", "doc_id % 3 = 0 AS is_public",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 700 AS int)) AS crawled_at",
        "CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP_NTZ '2024-01-30 00:00:00' END AS deleted_at",
        "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 101) / 100.0D END AS quality_score",
        "cast(5 + doc_id % 20 AS int) AS salary_min", "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(10 + doc_id % 30 AS int) END AS salary_max", "cast(doc_id % 6 AS int) AS n_tags",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of postings with their vectors."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "vec_id % 100 AS jd_id", "cast(vec_id div 100 AS int) AS chunk_index", "embedding", "concat('u', vec_id % 7) AS user_id",
        "CASE label % 5 WHEN 0 THEN 'responsibility' WHEN 1 THEN 'requirement' WHEN 2 THEN 'overview' WHEN 3 THEN 'nice_to_have' ELSE 'full' END AS chunk_type",
        "CASE vec_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'mixed' END AS language", "vec_id % 3 = 0 AS translated", "cast(vec_id % 5 AS int) AS retry_count",
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chunk_text: the document of the same number, whole."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS chunk_text")


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of model calls."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id", "ts AS created_at", "user_id", "concat('m', user_id % 3) AS model",
        "CASE event_type WHEN 'click' THEN 'judge_batch' WHEN 'view' THEN 'analyze' WHEN 'purchase' THEN 'retrieve' WHEN 'signup' THEN 'embed' ELSE 'judge_single' END AS operation",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cache_hit' ELSE 'success' END AS status",
        "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'MOCK' WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'timeout' END AS error_type",
        "value AS latency_ms", "try_cast(get_json_object(props, '$.k') AS bigint) AS total_tokens",
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of quality checks."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "ts AS checked_at", "'retrieval' AS check_type", "value AS score", "try_cast(get_json_object(props, '$.k') AS double) AS latency",
        "CASE user_id % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' END AS rerank",
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS user_id", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'paused' END AS status", "o_orderdate AS updated_at", "o_totalprice AS total")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of matches between resumes and postings."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS user_id", "o_custkey AS resume_id", "o_orderkey % 997 AS jd_id", "least(100.0D, o_totalprice / 5000) AS score",
        "o_orderstatus = 'F' AS applied", "o_orderdate AS created_at", "CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at",
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged result lists: one row for each query and rank, dealt by query to as many tasks as there are rows
    for, so that what a task sorts doesn't grow with the table."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", SORTED_ROWS).withColumn("rank", F.row_number().over(w)).selectExpr(
        "l_orderkey AS query_id", "l_partkey AS candidate", "rank", "cast(1 + cast(l_quantity AS bigint) % 5 AS int) AS score", "cast(1 + l_partkey % 5 AS int) AS score2",
        "l_returnflag = 'R' AS is_mock", "l_linestatus AS source", "l_suppkey % 7 = 0 AS is_origin",
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of each user: brands of the parts ordered."""
    orders, lines, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(parts, parts.p_partkey == lines.l_partkey)
    return rows.groupBy(F.col("o_custkey").alias("user_id")).agg(F.sort_array(F.collect_set("p_brand")).alias("skills"), F.countDistinct("o_orderkey").alias("n_orders"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes of the customers: the parts they ordered as skills, in mixed case, and years. Keys of parts are
    gathered, by order and then by customer, and named at the end, as shuffles of names are three times as large."""
    orders, lines = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderkey", F.col("o_custkey").alias("id")).agg(F.collect_set("l_partkey").alias("parts"))
    rows = rows.select("id", "parts").repartition("id").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"), (F.count("*") % 5).cast("int").alias("years"))
    return rows.selectExpr("id", "transform(parts, k -> concat(CASE WHEN k % 2 = 0 THEN 'TOOL ' ELSE 'Tool ' END, k)) AS skills", "years")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs: an order's parts as wanted skills. Keys of parts are gathered and named at the end."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").repartition("id").groupBy("id").agg(F.collect_set("l_partkey").alias("parts"))
    return rows.selectExpr("id", "transform(parts, k -> concat(CASE WHEN id % 3 = 0 THEN 'TOOL ' ELSE 'tool ' END, k)) AS skills")


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes that were read: contact, counts, and entries of experience and projects by order."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b")))
    text = lambda n, x: F.when(k % n == 0, None).when(k % n == 1, " ").otherwise(x)
    job = F.struct(k.alias("at"), text(4, "Acme").alias("company"), text(5, "Dev").alias("title"), F.when(k % 7 > 0, F.concat((k % 7).cast("string"), F.lit(" 月"))).alias("duration"), text(6, "did it").alias("description"), said.alias("achievements"))
    project = F.struct(k.alias("at"), text(3, "P").alias("name"), text(5, "R").alias("role"), said.alias("tech_stack"), text(4, "D").alias("description"), said.alias("achievements"))
    nested = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") != "F", job))).alias("experience"), F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", project))).alias("projects"))
    return table(spark, sf_dir, "customer").selectExpr(*fields(CONTACT)).join(nested, "id", "left")


def fields(columns: str) -> list[str]:
    """A list of named expressions as one for each column."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not quoted and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version tree: rows with their parent."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 50 = 7 THEN -1 ELSE p_partkey - 1 END AS parent_id", "nullif(p_size, 7) AS version", "p_partkey % 50 = 3 AS is_primary", "p_partkey div 50 AS user_id", "p_retailprice AS updated_at")
