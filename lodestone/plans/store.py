"""Store reads, filters and writes over the canonical frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mutate, store
from ..operators.tables import StoredTable
from ..sources import frames as S
from ..sources.files import work_path, work_table
from .registry import query

PICK = "id, user_id, title, company, source, is_public, crawled_at"
COLS = PICK.split(", ")
LIVE = "deleted_at IS NULL"
NOW = f"TIMESTAMP '{S.AS_OF}'"


@query("scan_table", f"SELECT id, user_id, source, n_tags, CAST(range(0, n_tags) AS BIGINT[]) AS tags FROM jds WHERE {LIVE}", ("jds",))
def scan_table(spark, d):
    """JSON list columns are decoded; null and malformed give an empty list."""
    stored = S.live(S.jds(spark, d)).withColumn("stored", F.when(F.col("n_tags") > 0, F.to_json(F.expr("sequence(0L, n_tags - 1L)"))).otherwise(F.lit("not json")))
    return stored.select("id", "user_id", "source", "n_tags", T.json_list(F.col("stored"), "bigint").alias("tags"))


@query("get_by_id", f"SELECT {PICK} FROM jds WHERE id = 40 AND {LIVE}", ("jds",))
def get_by_id(spark, d):
    return store.by_id(S.jds(spark, d), 40).select(*COLS)


@query("get_by_natural_key", f"SELECT {PICK} FROM jds WHERE url = 'http://x.example/job/40?p=1#top' AND user_id = 'u5' AND {LIVE}", ("jds",))
def get_by_natural_key(spark, d):
    return S.live(S.jds(spark, d)).where((F.col("url") == "http://x.example/job/40?p=1#top") & (F.col("user_id") == "u5")).select(*COLS)


@query("list_by_user", f"SELECT id, user_id, jd_id, score, created_at FROM matches WHERE user_id = 7 AND {LIVE} ORDER BY created_at DESC, id DESC LIMIT 20", ("matches",))
def list_by_user(spark, d):
    return store.newest(S.live(S.matches(spark, d)), "created_at", 20, user_id=7).select("id", "user_id", "jd_id", "score", "created_at")


@query("list_logs", "SELECT id, created_at, model, operation, status FROM llm_calls WHERE model = 'm1' AND status = 'error' ORDER BY created_at DESC, id DESC LIMIT 100", ("llm_calls",))
def list_logs(spark, d):
    return store.newest(S.llm_calls(spark, d), "created_at", 100, model="m1", operation=None, status="error").select("id", "created_at", "model", "operation", "status")


@query("search_jds", f"SELECT {PICK} FROM jds WHERE {LIVE} AND user_id = 'u3' AND (contains(lower(title), 'the') OR contains(lower(company), 'the') OR contains(lower(raw_text), 'the')) AND industry_tag = 'src1' ORDER BY crawled_at DESC, id DESC LIMIT 50", ("jds",))
def search_jds(spark, d):
    return store.search(S.jds(spark, d), "The", "u3", 50, industry_tag="src1", function_tag=None, position_tag=None).select(*COLS)


_SEEN = f"{LIVE} AND (user_id = 'u2' OR is_public) AND (contains(lower(title), 'de') OR contains(lower(company), 'de') OR contains(lower(raw_text), 'de') OR contains(lower(position_tag), 'de'))"


@query("visible_jds", f"SELECT {PICK} FROM jds WHERE {_SEEN} ORDER BY is_public, crawled_at DESC, id LIMIT 30 OFFSET 10", ("jds",))
def visible_jds(spark, d):
    return store.page(store.visible(S.jds(spark, d), "u2", "de"), [F.asc("is_public"), F.desc("crawled_at"), F.asc("id")], 30, 10).select(*COLS)


@query("count_visible", f"SELECT count(*) AS n FROM jds WHERE {_SEEN}", ("jds",))
def count_visible(spark, d):
    return store.visible(S.jds(spark, d), "u2", "de").agg(F.count("*").alias("n"))


@query("get_visible_jd", f"SELECT {PICK} FROM jds WHERE {LIVE} AND (user_id = 'u2' OR is_public) AND id = 30", ("jds",))
def get_visible_jd(spark, d):
    return store.visible(S.jds(spark, d), "u2").where("id = 30").select(*COLS)


@query("distinct_sources", f"SELECT DISTINCT source FROM jds WHERE {LIVE} AND (user_id = 'u2' OR is_public) AND source <> '' ORDER BY source", ("jds",))
def distinct_sources(spark, d):
    return store.distinct_values(store.visible(S.jds(spark, d), "u2"), "source")


@query("offset_page", f"SELECT {PICK} FROM jds WHERE {LIVE} ORDER BY crawled_at DESC, id LIMIT 25 OFFSET 50", ("jds",))
def offset_page(spark, d):
    return store.page(S.live(S.jds(spark, d)), [F.desc("crawled_at"), F.asc("id")], 25, 50).select(*COLS)


@query("publish_seed", "SELECT id, is_public OR (deleted_at IS NULL AND source IN ('src1', 'src2')) AS is_public FROM jds", ("jds",))
def publish_seed(spark, d):
    seed = F.col("deleted_at").isNull() & F.col("source").isin("src1", "src2")
    return S.jds(spark, d).select("id", F.when(seed, True).otherwise(F.col("is_public")).alias("is_public"))


@query("filter_garbage", f"SELECT id, source FROM jds WHERE {LIVE} AND (is_public OR user_id = 'u0') AND source IN ('src1', 'src2', 'src3') AND (contains(lower(raw_text), 'verify') OR contains(lower(raw_text), 'license') OR contains(lower(raw_text), 'blocked')) AND (length(trim(raw_text)) < 300 OR trim(title) = '' OR trim(company) = '')", ("jds",))
def filter_garbage(spark, d):
    rows = S.live(S.jds(spark, d)).where("is_public or user_id = 'u0'")
    return rows.where(T.is_garbage("source", "title", "company", "raw_text", F.col("position_tag"), crawled=("src1", "src2", "src3"), words=("verify", "license", "blocked"))).select("id", "source")


@query("filter_threshold_strategy", "SELECT m.id, s.strategy, m.score FROM matches m, (VALUES ('aggressive', 65), ('balanced', 70), ('conservative', 75)) s(strategy, least) WHERE m.score >= s.least", ("matches",))
def filter_threshold_strategy(spark, d):
    least = F.create_map(*[F.lit(x) for x in ("aggressive", 65, "balanced", 70, "conservative", 75)])
    rows = S.matches(spark, d).select("id", "score", F.explode(least).alias("strategy", "least"))
    return rows.where("score >= least").select("id", "strategy", "score")


_BY = "list_sort(coalesce(list(o_orderkey) FILTER (WHERE {}), []))"


@query("filter_attr", f"SELECT o_custkey AS user_id, {_BY.format("o_orderpriority = '1-URGENT'")} AS urgent, {_BY.format("o_orderstatus = 'F'")} AS by_section FROM orders GROUP BY o_custkey")
def filter_attr(spark, d):
    """Suggestions by priority and by section, from a variant column that was parsed when it was written."""
    one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("section"))
    written = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("suggestions"))).alias("j"))
    stored = work_table(written.select("user_id", F.try_parse_json("j").alias("v")), "suggestions")
    said = stored.select("user_id", F.try_variant_get("v", "$.suggestions", "array<struct<id:bigint,priority:string,section:string>>").alias("s"))
    ids = lambda keep: F.transform(F.filter("s", keep), lambda x: x.id)
    return said.select("user_id", ids(lambda x: x.priority == "1-URGENT").alias("urgent"), ids(lambda x: x.section == "F").alias("by_section"))


@query("filter_recent_or_null", "SELECT id, salary_max FROM jds WHERE salary_max <= 15 OR salary_max IS NULL ORDER BY salary_max NULLS FIRST, id LIMIT 100", ("jds",))
def filter_recent_or_null(spark, d):
    return S.jds(spark, d).where("salary_max <= 15 or salary_max is null").orderBy(F.asc_nulls_first("salary_max"), "id").limit(100).select("id", "salary_max")


@query("filter_untranslated", "SELECT id, language, retry_count FROM chunks WHERE language IN ('en', 'mixed') AND NOT translated AND retry_count < 3 ORDER BY id LIMIT 64", ("chunks",))
def filter_untranslated(spark, d):
    return S.chunks(spark, d).where("language in ('en', 'mixed') and not translated and retry_count < 3").orderBy("id").limit(64).select("id", "language", "retry_count")


@query("filter_exists_or_default", f"SELECT id FROM jds WHERE quality_score IS NULL AND {LIVE}", ("jds",))
def filter_exists_or_default(spark, d):
    return S.live(S.jds(spark, d)).where("quality_score is null").select("id")


CACHE = "SELECT o_orderkey AS id, o_orderpriority AS position, o_orderstatus AS industry, CASE WHEN o_orderkey % 3 > 0 THEN 'f' || (o_orderkey % 4) END AS function, o_orderdate AS updated_at, {} AS expires_at FROM orders"


def cache(spark, d):
    return S.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS position", "o_orderstatus AS industry", "CASE WHEN o_orderkey % 3 > 0 THEN concat('f', o_orderkey % 4) END AS function", "o_orderdate AS updated_at", "o_orderdate + INTERVAL '100' DAY AS expires_at")


@query("cache_lookup", f"SELECT * FROM ({CACHE.format('o_orderdate + INTERVAL 100 DAY')}) WHERE position = '5-LOW' AND industry = 'F' AND (function IS NULL OR function = 'f1') AND expires_at > TIMESTAMP '2001-01-01' ORDER BY function IS NOT NULL DESC, updated_at DESC, id DESC LIMIT 1")
def cache_lookup(spark, d):
    return store.cached(cache(spark, d), "5-LOW", "F", "f1", F.lit("2001-01-01").cast("timestamp_ntz"))


@query("latest_draft", "SELECT user_id, id, status, updated_at FROM drafts WHERE status IN ('open', 'paused') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) = 1", ("drafts",))
def latest_draft(spark, d):
    return store.first_by(S.drafts(spark, d).where("status in ('open', 'paused')"), ["user_id"], F.desc("updated_at"), F.desc("id")).select("user_id", "id", "status", "updated_at")


@query("live_snapshot", f"SELECT count(*) AS total, count(*) FILTER (WHERE crawled_at >= {NOW} - INTERVAL 7 DAY) AS recent, count(DISTINCT industry_tag) AS industries, count(DISTINCT source) AS platforms FROM jds WHERE {LIVE}", ("jds",))
def live_snapshot(spark, d):
    recent = F.col("crawled_at") >= S.as_of() - F.expr("INTERVAL '7' DAY")
    return S.live(S.jds(spark, d)).agg(F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.countDistinct("industry_tag").alias("industries"), F.countDistinct("source").alias("platforms"))


@query("case_bands", "SELECT id, CASE WHEN quality_score IS NULL THEN 'unrated' WHEN quality_score >= 0.7 THEN '4' WHEN quality_score >= 0.5 THEN '3' WHEN quality_score >= 0.3 THEN '2' ELSE '1' END AS stars, CASE WHEN quality_score * 100 >= 85 THEN 'high' WHEN quality_score * 100 >= 70 THEN 'medium' ELSE 'low' END AS level, CASE WHEN length(title) > 15 THEN 'long' WHEN length(title) > 5 THEN 'medium' ELSE 'short' END AS form, CASE WHEN quality_score >= 0.1 THEN 'red' WHEN quality_score >= 0.03 THEN 'amber' ELSE 'green' END AS colour FROM jds", ("jds",))
def case_bands(spark, d):
    q = F.col("quality_score")
    return S.jds(spark, d).select("id", T.stars(q).alias("stars"), T.band(q * 100, [(85, "high"), (70, "medium")], "low").alias("level"), T.above(F.length("title"), [(15, "long"), (5, "medium")], "short").alias("form"), T.band(q, [(0.10, "red"), (0.03, "amber")], "green").alias("colour"))


# -- writes -----------------------------------------------------------------------------------------

_KEEP = "id, user_id, url"
_NEW = "SELECT page_id + 1000000 AS id, 'u' || (page_id % 7) AS user_id, 'http://x.example/job/' || (page_id % 600) || '?p=1#top' AS url FROM pages"


def incoming_pages(spark, d):
    return S.table(spark, d, "pages").selectExpr("page_id + 1000000 AS id", "concat('u', page_id % 7) AS user_id", "concat('http://x.example/job/', page_id % 600, '?p=1#top') AS url")


def stored_jds(spark, d):
    """Postings that a unique (url, user_id) lets in."""
    return store.first_by(S.jds(spark, d), ["url", "user_id"], F.asc("id")).select("id", "user_id", "url")


_STORED = f"SELECT {_KEEP} FROM jds QUALIFY row_number() OVER (PARTITION BY url, user_id ORDER BY id) = 1"


@query("insert_ignore", f"SELECT * FROM ({_STORED}) UNION ALL SELECT {_KEEP} FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM jds j WHERE j.url = n.url AND j.user_id = n.user_id) QUALIFY row_number() OVER (PARTITION BY url, user_id ORDER BY id) = 1", ("jds",))
def insert_ignore(spark, d):
    return mutate.insert_ignore(stored_jds(spark, d), incoming_pages(spark, d), ["url", "user_id"], F.asc("id"))


@query("insert_ignore_id", f"SELECT n.id, coalesce(j.id, min(n.id) OVER (PARTITION BY n.url, n.user_id)) AS stored_id FROM ({_NEW}) n LEFT JOIN ({_STORED}) j ON j.url = n.url AND j.user_id = n.user_id", ("jds",))
def insert_ignore_id(spark, d):
    """The id under which each incoming row's key is stored after an insert that ignores known keys."""
    return mutate.surviving_ids(stored_jds(spark, d), incoming_pages(spark, d), ["url", "user_id"], F.asc("id"))


@query("anti_join_dedup", f"SELECT {_KEEP} FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM jds j WHERE j.url = n.url AND j.user_id = n.user_id)", ("jds",))
def anti_join_dedup(spark, d):
    return incoming_pages(spark, d).join(S.jds(spark, d).select("url", "user_id").distinct(), ["url", "user_id"], "left_anti").select("id", "user_id", "url")


@query("insert_replace", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 3 AS version FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal, 1 FROM customer WHERE c_custkey % 4 = 0")
def insert_replace(spark, d):
    rows = S.table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "3 AS version")
    new = rows.where("id % 4 = 0").selectExpr("id", "concat('new ', name) AS name", "balance")
    return mutate.insert_replace(rows, new, "id", {"version": F.lit(1)})


@query("upsert_coalesce", "SELECT id, user_id, CASE WHEN id % 5 = 0 THEN 'replaced' ELSE status END AS status, updated_at, CASE WHEN id % 10 = 0 THEN 1.0::DOUBLE ELSE total END AS total FROM drafts UNION ALL SELECT c_custkey + 100000000, c_custkey, 'replaced', TIMESTAMP '2024-01-01', NULL FROM customer", ("drafts",))
def upsert_coalesce(spark, d):
    rows = S.drafts(spark, d)
    old = rows.where("id % 5 = 0").selectExpr("id", "user_id", "'replaced' AS status", "updated_at", "CASE WHEN id % 10 = 0 THEN 1.0D END AS total")
    new = S.table(spark, d, "customer").selectExpr("c_custkey + 100000000 AS id", "c_custkey AS user_id", "'replaced' AS status", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at", "cast(NULL AS double) AS total")
    return mutate.upsert(rows, old.unionByName(new), "id", keep=["total"])


@query("upsert_partition", "SELECT id, user_id, status, CASE WHEN status = 'open' AND id % 10 = 0 THEN total + 1 ELSE total END AS total FROM drafts UNION ALL SELECT c_custkey + 100000000, c_custkey, 'open', NULL FROM customer", ("drafts",))
def upsert_partition(spark, d):
    """An upsert into a table stored by status, of which it rewrites one partition."""
    rows = S.drafts(spark, d).select("id", "user_id", "status", "total")
    table = StoredTable.create(rows, work_path(spark, "drafts"), ["status"])
    new = rows.where("status = 'open' and id % 10 = 0").withColumn("total", F.col("total") + 1).unionByName(S.table(spark, d, "customer").selectExpr("c_custkey + 100000000 AS id", "c_custkey AS user_id", "'open' AS status", "cast(NULL AS double) AS total"))
    table.merge(new, "id", lambda old, more: mutate.upsert(old, more, "id"))
    return table.read()


@query("upsert_cache", f"SELECT id, position, industry, function, CASE WHEN id % 7 = 0 THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN id % 7 = 0 THEN {NOW} + INTERVAL 24 HOUR ELSE expires_at END AS expires_at FROM ({CACHE.format('o_orderdate + INTERVAL 100 DAY')})")
def upsert_cache(spark, d):
    rows = cache(spark, d)
    new = rows.where("id % 7 = 0").withColumns({"updated_at": S.as_of(), "expires_at": S.as_of() + F.expr("INTERVAL '24' HOUR")})
    return mutate.upsert(rows, new, "id")


@query("append_log", "SELECT id, operation, status, total_tokens FROM llm_calls UNION ALL SELECT id + 1000000000, 'audit', 'success', 0 FROM llm_calls WHERE status = 'error'", ("llm_calls",))
def append_log(spark, d):
    rows = S.llm_calls(spark, d).select("id", "operation", "status", "total_tokens")
    return rows.unionByName(rows.where("status = 'error'").selectExpr("id + 1000000000 AS id", "'audit' AS operation", "'success' AS status", "0L AS total_tokens"))


_DIM = "CASE page_id % 3 WHEN 0 THEN 512 ELSE 64 END"


@query("bulk_append_chunks", f"WITH new AS (SELECT p.page_id + 1000000 AS id, p.page_id % 100 AS jd_id, CAST(coalesce(t.top, -1) + row_number() OVER (PARTITION BY p.page_id % 100 ORDER BY p.page_id) AS INTEGER) AS chunk_index, {_DIM} AS dim FROM pages p LEFT JOIN (SELECT jd_id, max(chunk_index) AS top FROM chunks GROUP BY jd_id) t ON t.jd_id = p.page_id % 100) SELECT 'chunk' AS store, id, jd_id, chunk_index FROM chunks UNION ALL SELECT 'chunk', id, jd_id, chunk_index FROM new UNION ALL SELECT 'index', id, jd_id, chunk_index FROM new WHERE dim = 512".replace("WITH new AS", ", new AS"), ("chunks",))
def bulk_append_chunks(spark, d):
    """Chunks are numbered on within their posting; those with vectors of 512 numbers go to the index too."""
    rows = S.chunks(spark, d).selectExpr("id", "jd_id", "chunk_index", "cast(NULL AS int) AS dim")
    new = S.table(spark, d, "pages").selectExpr("page_id + 1000000 AS id", "page_id % 100 AS jd_id", f"{_DIM} AS dim")
    stores = F.array_compact(F.array(F.lit("chunk"), F.when(F.col("dim") == 512, "index")))
    return mutate.append_indexed(rows, new, "jd_id", ["id"], "chunk_index").select(F.explode(stores).alias("store"), "id", "jd_id", "chunk_index")


@query("point_update", "SELECT id, applied OR id % 6 = 0 AS applied, CASE WHEN id % 6 = 0 THEN NULL ELSE score END AS score FROM matches", ("matches",))
def point_update(spark, d):
    rows = S.matches(spark, d).select("id", "applied", "score")
    return mutate.update(rows, rows.where("id % 6 = 0").selectExpr("id", "true AS applied", "cast(NULL AS double) AS score"), "id", ["applied", "score"])


@query("cas_update", "SELECT id, CASE WHEN id % 2 = 0 AND (deleted_at IS NULL OR id % 3 = 0) THEN 0.5::DOUBLE ELSE quality_score END AS quality_score, id % 2 = 0 AND (deleted_at IS NULL OR id % 3 = 0) AS changed FROM jds", ("jds",))
def cas_update(spark, d):
    rows = S.jds(spark, d).select("id", "quality_score", "deleted_at")
    new = rows.where("id % 2 = 0").selectExpr("id", "0.5D AS quality_score", "CASE WHEN id % 3 = 0 THEN deleted_at END AS expected")
    return mutate.compare_and_set(rows, new, "id", "deleted_at", ["quality_score"]).select("id", "quality_score", "changed")


@query("compute_if_absent", "SELECT id, coalesce(quality_score, length(title) / 60.0::DOUBLE) AS quality_score FROM jds", ("jds",))
def compute_if_absent(spark, d):
    return S.jds(spark, d).select("id", F.coalesce("quality_score", F.length("title") / F.lit(60.0)).alias("quality_score"))


@query("soft_delete_cascade", f"SELECT 'jd' AS kind, id, CASE WHEN id % 4 = 0 AND deleted_at IS NULL THEN {NOW} ELSE deleted_at END AS deleted_at FROM jds UNION ALL SELECT 'chunk', id, CASE WHEN jd_id % 4 = 0 AND id % 9 > 0 THEN {NOW} WHEN id % 9 = 0 THEN TIMESTAMP '2024-01-02' END FROM chunks", ("jds", "chunks"))
def soft_delete_cascade(spark, d):
    rows = S.jds(spark, d).select("id", "deleted_at")
    below = S.chunks(spark, d).selectExpr("id", "jd_id", "CASE WHEN id % 9 = 0 THEN TIMESTAMP_NTZ '2024-01-02 00:00:00' END AS deleted_at")
    a, b = mutate.soft_delete(rows, below, rows.where("id % 4 = 0"), "jd_id", S.as_of())
    return a.selectExpr("'jd' AS kind", "id", "deleted_at").unionByName(b.selectExpr("'chunk' AS kind", "id", "deleted_at"))


@query("ttl_delete", f"SELECT id, created_at FROM llm_calls WHERE epoch_us({NOW}) - epoch_us(created_at) <= 10 * 86400000000", ("llm_calls",))
def ttl_delete(spark, d):
    return mutate.older_than(S.llm_calls(spark, d).select("id", "created_at"), "created_at", 10, S.as_of())


@query("set_exclusive_flag", "SELECT id, user_id, id = max(id) OVER (PARTITION BY user_id) AS is_primary FROM matches", ("matches",))
def set_exclusive_flag(spark, d):
    rows = S.matches(spark, d).select("id", "user_id")
    top = rows.groupBy("user_id").agg(F.max("id").alias("target"))
    return mutate.set_exclusive(rows.join(top, "user_id", "left"), F.col("id") == F.col("target"), "is_primary").select("id", "user_id", "is_primary")


@query("clone_version", "SELECT id, parent_id, version, is_primary FROM tree UNION ALL SELECT id + 10000000, id, coalesce(version, 1) + 1, CASE WHEN id % 6 = 0 THEN false ELSE is_primary END FROM tree WHERE id % 3 = 0", ("tree",))
def clone_version(spark, d):
    rows = S.tree(spark, d).select("id", "parent_id", "version", "is_primary")
    change = rows.where("id % 3 = 0").selectExpr("id AS source_id", "CASE WHEN id % 6 = 0 THEN false END AS is_primary")
    return rows.unionByName(mutate.clone_version(rows, change, F.col("s.id") + 10000000))


_OLD = "doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '[\"a\", \"b' || doc_id || '\"]' WHEN 1 THEN 'plain' WHEN 2 THEN '{\"k\": ' || doc_id || '}' END AS tags, CASE doc_id % 3 WHEN 0 THEN '{\"n\": 1}' WHEN 1 THEN 'no json' END AS sections, CAST(doc_id % 2 AS INT) AS is_public, CASE WHEN doc_id % 5 > 0 THEN 'u' || doc_id % 7 WHEN doc_id % 10 = 0 THEN '' END AS user_id"


@query("migrate_copy_table", f"SELECT id, CASE WHEN tags IS NULL THEN NULL WHEN id % 4 = 0 THEN ['a', 'b' || id] ELSE [tags] END AS tags, CASE WHEN sections IS NULL OR json_valid(sections) THEN sections ELSE CAST(to_json(sections) AS VARCHAR) END AS sections, is_public = 1 AS is_public, coalesce(nullif(user_id, ''), 'nobody') AS user_id FROM (SELECT {_OLD} FROM documents) WHERE id % 6 > 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'kept' FROM documents WHERE doc_id % 6 = 0")
def migrate_copy_table(spark, d):
    """Rows of new keys, by the columns that both stores have, coerced to the other store's types."""
    source = S.table(spark, d, "documents").selectExpr(*S.fields(_OLD)).withColumn("dropped", F.lit(1))
    target = S.table(spark, d, "documents").where("doc_id % 6 = 0").selectExpr("doc_id AS id", "cast(NULL AS array<string>) AS tags", "cast(NULL AS string) AS sections", "cast(NULL AS boolean) AS is_public", "'kept' AS user_id")
    return mutate.copy_shared_columns(source, target, "id", {"tags": "array", "sections": "json", "is_public": "bool"}, user_id=F.lit("nobody"))


_JOBS = "id, CASE WHEN id % 9 > 0 THEN url END AS url, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE title END AS title, source, salary_min, CAST(NULL AS VARCHAR(9)) AS salary_str"
_CRAWLED = "page_id AS id, CASE page_id % 11 WHEN 0 THEN '?p=1' WHEN 1 THEN 'http://x.example/job/' || (page_id % 400) || '#top' ELSE url END AS url, CASE WHEN page_id % 3 > 0 THEN 'Page ' || page_id END AS title, page_id % 40 || 'K' AS salary_str"


@query("migrate_merge_sources", f"SELECT * EXCLUDE (place) FROM (SELECT id, split_part(split_part(url, '?', 1), '#', 1) AS url, coalesce(nullif(title, ''), 'Unknown') AS title, source, salary_min, salary_str, place FROM (SELECT {_JOBS.replace('source', "'crawler' AS source")}, 0 AS place FROM jds UNION ALL SELECT id, url, title, 'jd_crawler', NULL, salary_str, 1 FROM (SELECT {_CRAWLED} FROM pages))) WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY place, id) = 1", ("jds",))
def migrate_merge_sources(spark, d):
    """Two older tables as one: the first knows salaries as numbers, the second as text; sources are labelled anew."""
    jobs = S.jds(spark, d).selectExpr(*S.fields(_JOBS)).drop("salary_str")
    crawled = S.table(spark, d, "pages").selectExpr(*S.fields(_CRAWLED))
    return mutate.merge_sources({"crawler": jobs, "jd_crawler": crawled}, T.strip_url).select("id", "url", "title", "source", "salary_min", "salary_str")


_MERGED = "SELECT split_part(split_part(url, '?', 1), '#', 1) AS url, origin, id FROM (SELECT CASE WHEN id % 9 > 0 THEN url END AS url, 'jds' AS origin, id FROM jds UNION ALL SELECT url, 'pages', page_id FROM pages)"


@query("migrate_merge_counts", f"SELECT origin, count(*) AS n, count(*) FILTER (WHERE url IS NOT NULL AND first) AS inserted, count(*) FILTER (WHERE url IS NOT NULL AND NOT first) AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY origin, id) = 1 AS first FROM ({_MERGED})) GROUP BY origin", ("jds",))
def migrate_merge_counts(spark, d):
    """How many rows of each source a merge inserts, and finds to be known; those without an address count as neither."""
    both = S.jds(spark, d).selectExpr("CASE WHEN id % 9 > 0 THEN url END AS url", "'jds' AS origin", "id").unionByName(S.table(spark, d, "pages").selectExpr("url", "'pages' AS origin", "page_id AS id"))
    both = both.withColumn("url", T.strip_url(F.col("url")))
    kept = store.first_by(both.where("url is not null"), ["url"], F.asc("origin"), F.asc("id")).groupBy("origin").agg(F.count("*").alias("inserted"))
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("url").alias("named")).join(kept, "origin", "left").select("origin", "n", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("named") - F.coalesce("inserted", F.lit(0))).alias("duplicate"))


@query("union_sources", "SELECT 'jds' AS origin, count(*) AS n, count(DISTINCT url) AS urls FROM jds UNION ALL SELECT 'pages', count(*), count(DISTINCT url) FROM pages", ("jds",))
def union_sources(spark, d):
    both = S.jds(spark, d).selectExpr("url", "'jds' AS origin", "company").unionByName(S.table(spark, d, "pages").selectExpr("url", "'pages' AS origin", "html"), allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


@query("column_intersect", "SELECT 'doc_id' AS shared, count(doc_id) AS filled, (SELECT count(item_id) FROM benchmark) AS filled_there FROM documents UNION ALL SELECT 'text', count(text), (SELECT count(text) FROM benchmark) FROM documents")
def column_intersect(spark, d):
    """Columns that documents and a narrower target have in common, and how many rows of either have a value."""
    source, target = S.table(spark, d, "documents"), S.table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")
    shared = [c for c in source.columns if c in target.columns]
    filled = lambda df, name: df.agg(*[F.count(c).alias(c) for c in shared]).unpivot([], shared, "shared", name)
    return filled(source, "filled").join(filled(target, "filled_there"), "shared")


_LOOSE = "doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN '[\"r' || doc_id || '\"]' END AS requirements, CASE WHEN doc_id % 4 = 0 THEN '[\"p\", \"q\"]' END AS preferred, CASE WHEN doc_id % 5 > 1 THEN '[\"' || source || '\"]' END AS skills, CASE WHEN doc_id % 2 = 0 THEN lang END AS implicit"


@query("schema_converge", f"SELECT id, CASE WHEN requirements IS NULL THEN [] ELSE ['r' || id] END AS requirements, CASE WHEN preferred IS NULL THEN [] ELSE ['p', 'q'] END AS preferred, CASE WHEN skills IS NULL THEN [] ELSE [source] END AS skills, coalesce(implicit, '') AS implicit, coalesce(skills, '[]') AS tags FROM (SELECT {_LOOSE}, source FROM documents)")
def schema_converge(spark, d):
    """Loose JSON columns become one JSON object and a list, with defaults, and are read back by schema."""
    rows = S.table(spark, d, "documents").selectExpr(*S.fields(_LOOSE))
    lists = [T.json_list(F.col(c)).alias(c) for c in ("requirements", "preferred", "skills")]
    packed = rows.select("id", F.to_json(F.struct(*lists, F.coalesce("implicit", F.lit("")).alias("implicit"))).alias("parsed_sections"), F.coalesce("skills", F.lit("[]")).alias("tags"))
    return packed.select("id", F.from_json("parsed_sections", "requirements array<string>, preferred array<string>, skills array<string>, implicit string").alias("s"), "tags").select("id", "s.*", "tags")
