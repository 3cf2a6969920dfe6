"""Queries by name, with the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import frames as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_SOME = "CASE o_orderkey % {0} WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE {1} END"
_SAID = "CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN [''] ELSE ['a', 'b'] END"
#: Canonical frames as SQL over the driver's tables; ``lodestone.sources.frames`` builds the same in Spark.
FRAMES_SQL = {
    "jds": """SELECT doc_id AS id, 'u' || (doc_id % 7) AS user_id, 'http://x.example/job/' || (doc_id % 400) || '?p=1#top' AS url,
        substr(split_part(text, chr(10), 1), 1, 60) AS title, 'c' || (doc_id % 23) AS company, text AS raw_text, source, lang AS language,
        source AS industry_tag, lang AS function_tag, 'p' || (doc_id % 5) AS position_tag, doc_id % 3 = 0 AS is_public,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 700 AS INTEGER)) AS crawled_at,
        CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' END AS deleted_at,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 101) / 100.0::DOUBLE END AS quality_score,
        CAST(5 + doc_id % 20 AS INTEGER) AS salary_min, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(10 + doc_id % 30 AS INTEGER) END AS salary_max,
        CAST(doc_id % 6 AS INTEGER) AS n_tags FROM documents""",
    "chunks": """SELECT vec_id AS id, vec_id % 100 AS jd_id, CAST(vec_id // 100 AS INTEGER) AS chunk_index, embedding, 'u' || (vec_id % 7) AS user_id,
        CASE label % 5 WHEN 0 THEN 'responsibility' WHEN 1 THEN 'requirement' WHEN 2 THEN 'overview' WHEN 3 THEN 'nice_to_have' ELSE 'full' END AS chunk_type,
        CASE vec_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'mixed' END AS language, vec_id % 3 = 0 AS translated, CAST(vec_id % 5 AS INTEGER) AS retry_count FROM embeddings""",
    "chunk_texts": """SELECT doc_id AS id, text AS chunk_text FROM documents""",
    "llm_calls": """SELECT event_id AS id, ts AS created_at, user_id, 'm' || (user_id % 3) AS model,
        CASE event_type WHEN 'click' THEN 'judge_batch' WHEN 'view' THEN 'analyze' WHEN 'purchase' THEN 'retrieve' WHEN 'signup' THEN 'embed' ELSE 'judge_single' END AS operation,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cache_hit' ELSE 'success' END AS status,
        CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'MOCK' WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'timeout' END AS error_type,
        value AS latency_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS total_tokens FROM events""",
    "checks": """SELECT event_id AS id, ts AS checked_at, 'retrieval' AS check_type, value AS score, CAST(json_extract(props, '$.k') AS DOUBLE) AS latency,
        CASE user_id % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' END AS rerank FROM events""",
    "drafts": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'paused' END AS status,
        o_orderdate AS updated_at, o_totalprice AS total FROM orders""",
    "matches": """SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey AS resume_id, o_orderkey % 997 AS jd_id, least(100.0::DOUBLE, o_totalprice / 5000) AS score,
        o_orderstatus = 'F' AS applied, o_orderdate AS created_at, CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at FROM orders""",
    "ranked": """SELECT l_orderkey AS query_id, l_partkey AS candidate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS rank,
        CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS INTEGER) AS score, CAST(1 + l_partkey % 5 AS INTEGER) AS score2, l_returnflag = 'R' AS is_mock, l_linestatus AS source, l_suppkey % 7 = 0 AS is_origin FROM lineitem""",
    "skills": """SELECT o_custkey AS user_id, list_sort(list(DISTINCT p_brand)) AS skills, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey""",
    "people": """SELECT o_custkey AS id, list(DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'TOOL ' ELSE 'Tool ' END || l_partkey) AS skills, CAST(count(DISTINCT o_orderkey) % 5 AS INTEGER) AS years FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    "jobs": """SELECT l_orderkey AS id, list(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'TOOL ' ELSE 'tool ' END || l_partkey) AS skills FROM lineitem GROUP BY l_orderkey""",
    "postings": f"""SELECT p_partkey AS id, {S.POSTING} AS text FROM part""",
    "listings": f"""SELECT p_partkey AS id, {S.LISTING} AS text FROM part""",
    "cvs": f"""SELECT * FROM (SELECT {S.CONTACT} FROM customer) LEFT JOIN (SELECT o_custkey AS id,
        list({{'at': o_orderkey, 'company': {_SOME.format(4, "'Acme'")}, 'title': {_SOME.format(5, "'Dev'")}, 'duration': CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 7) || ' 月' END, 'description': {_SOME.format(6, "'did it'")}, 'achievements': {_SAID}}} ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS experience,
        list({{'at': o_orderkey, 'name': {_SOME.format(3, "'P'")}, 'role': {_SOME.format(5, "'R'")}, 'tech_stack': {_SAID}, 'description': {_SOME.format(4, "'D'")}, 'achievements': {_SAID}}} ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS projects
        FROM orders GROUP BY o_custkey) USING (id)""",
    "tree": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 50 = 7 THEN -1 ELSE p_partkey - 1 END AS parent_id, CAST(nullif(p_size, 7) AS INTEGER) AS version, p_partkey % 50 = 3 AS is_primary, p_partkey // 50 AS user_id, p_retailprice AS updated_at FROM part""",
}


def frames(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named frames."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({FRAMES_SQL[n]})" for n in names) + " "


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may refer to the frames it ``uses``, after which it may add its own."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (frames(*uses, recursive=recursive) + sql) if uses else sql
        return f

    return add
