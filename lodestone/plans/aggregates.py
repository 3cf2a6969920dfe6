"""Aggregates over logs and postings, windows, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import measure as M
from ..operators import store
from ..sources import frames as S
from . import scores
from .registry import query

NOW = f"TIMESTAMP '{S.AS_OF}'"
LIVE = "deleted_at IS NULL"


def rate(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


@query("agg_table_stats", f"SELECT 'jds' AS name, count(*) AS n FROM jds WHERE {LIVE} UNION ALL SELECT 'matches', count(*) FROM matches WHERE {LIVE} UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'llm_calls', count(*) FROM llm_calls UNION ALL SELECT 'drafts', count(*) FROM drafts", ("jds", "matches", "chunks", "llm_calls", "drafts"))
def agg_table_stats(spark, d):
    tables = {"jds": S.live(S.jds(spark, d)), "matches": S.live(S.matches(spark, d)), "chunks": S.chunks(spark, d), "llm_calls": S.llm_calls(spark, d), "drafts": S.drafts(spark, d)}
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("agg_usage_today", "SELECT user_id, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM llm_calls WHERE CAST(created_at AS DATE) = DATE '2024-01-30' GROUP BY user_id", ("llm_calls",))
def agg_usage_today(spark, d):
    today = S.llm_calls(spark, d).where(F.to_date("created_at") == F.lit("2024-01-30").cast("date"))
    return today.groupBy("user_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


@query("quota_check", "SELECT user_id, CASE WHEN total >= 2000 THEN 'global' WHEN calls >= 4 THEN 'user' ELSE 'ok' END AS scope FROM (SELECT user_id, count(*) AS calls, sum(count(*)) OVER () AS total FROM llm_calls WHERE CAST(created_at AS DATE) = DATE '2024-01-30' GROUP BY user_id)", ("llm_calls",))
def quota_check(spark, d):
    """The global limit is checked before the user's."""
    calls = S.llm_calls(spark, d).where(F.to_date("created_at") == F.lit("2024-01-30").cast("date")).groupBy("user_id").agg(F.count("*").alias("calls"))
    both = calls.crossJoin(F.broadcast(calls.agg(F.sum("calls").alias("total"))))  # one row
    return both.select("user_id", F.when(F.col("total") >= 2000, "global").when(F.col("calls") >= 4, "user").otherwise("ok").alias("scope"))


@query("lockout_check", "SELECT user_id, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3 HOUR AND created_at <= TIMESTAMP '2024-01-30 12:00:00') >= 2 AS locked FROM llm_calls WHERE status = 'error' GROUP BY user_id", ("llm_calls",))
def lockout_check(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    recent = (F.col("created_at") >= now - F.expr("INTERVAL '3' HOUR")) & (F.col("created_at") <= now)
    return S.llm_calls(spark, d).where("status = 'error'").groupBy("user_id").agg((F.count_if(recent) >= 2).alias("locked"))


@query("ops_mock_rate", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE coalesce(error_type LIKE '%MOCK%', false)) AS mock, round(count(*) FILTER (WHERE coalesce(error_type LIKE '%MOCK%', false)) / count(*), 4) AS rate FROM llm_calls WHERE operation LIKE '%judge%' AND created_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1", ("llm_calls",))
def ops_mock_rate(spark, d):
    rows = S.llm_calls(spark, d).where(F.col("operation").contains("judge") & (F.col("created_at") >= S.as_of() - F.expr("INTERVAL '7' DAY")))
    mock = F.count_if(F.coalesce(F.col("error_type").contains("MOCK"), F.lit(False)))
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), mock.alias("mock"), F.round(rate(mock, F.count("*")), 4).alias("rate"))


@query("ops_latency", f"SELECT coalesce(rerank, 'unknown') AS rerank, count(*) AS n, round(avg(latency), 4) AS mean, round(quantile_cont(latency, 0.95), 4) AS p95 FROM checks WHERE checked_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1", ("checks",))
def ops_latency(spark, d):
    """Equal latencies are counted first, so that a quantile is read off running counts of distinct values."""
    rows = S.checks(spark, d).where(F.col("checked_at") >= S.as_of() - F.expr("INTERVAL '7' DAY"))
    counts = rows.groupBy(F.coalesce("rerank", F.lit("unknown")).alias("rerank"), "latency").agg(F.count("*").alias("n"))
    return M.quantile(counts, "rerank", "latency", 0.95).select("rerank", "n", F.round("mean", 4).alias("mean"), F.round("quantile", 4).alias("p95"))


_GROWTH = "((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE))"
_BUCKETS = f"SELECT model, CASE WHEN latency_ms > 0 THEN ceil(ln(latency_ms) / ln({_GROWTH})) END AS bucket, count(*) AS n FROM llm_calls WHERE latency_ms IS NOT NULL AND created_at >= {NOW} - INTERVAL 14 DAY GROUP BY ALL"


@query("ops_latency_sketch", f"SELECT model, CAST(max(total) AS BIGINT) AS n, round(min(coalesce(2 * pow({_GROWTH}, bucket) / ({_GROWTH} + 1), 0)), 4) AS p95 FROM (SELECT *, sum(n) OVER (PARTITION BY model) AS total, sum(n) OVER (PARTITION BY model ORDER BY bucket NULLS FIRST) AS upto FROM ({_BUCKETS})) WHERE upto >= ceil(total * 0.95) GROUP BY model", ("llm_calls",))
def ops_latency_sketch(spark, d):
    """95 % latency by model over a fortnight, merged from a sketch for each day; within 1 % of the exact one."""
    days = M.sketch(S.llm_calls(spark, d).withColumn("day", F.to_date("created_at")), ["day", "model"], "latency_ms")
    fortnight = M.merge_sketches(days.where(F.col("day") >= F.to_date(S.as_of()) - 14), ["model"])
    return M.sketch_quantile(fortnight, ["model"], 0.95).select("model", "n", F.round("quantile", 4).alias("p95"))


@query("ops_success_rate", f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'cache_hit') AS cached, round(count(*) FILTER (WHERE status IN ('success', 'cache_hit')) / count(*), 4) AS success_rate FROM llm_calls WHERE created_at >= {NOW} - INTERVAL 7 DAY", ("llm_calls",))
def ops_success_rate(spark, d):
    rows = S.llm_calls(spark, d).where(F.col("created_at") >= S.as_of() - F.expr("INTERVAL '7' DAY"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("total"), is_("success").alias("success"), is_("error").alias("error"), is_("cache_hit").alias("cached"), F.round(rate(is_("success") + is_("cache_hit"), F.count("*")), 4).alias("success_rate"))


@query("ops_top_failures", "SELECT operation, coalesce(error_type, 'unknown') AS error, count(*) AS n FROM llm_calls WHERE status = 'error' GROUP BY 1, 2 ORDER BY n DESC, operation, error LIMIT 10", ("llm_calls",))
def ops_top_failures(spark, d):
    """Grouped by the filled-in error, so null and 'unknown' are one."""
    rows = S.llm_calls(spark, d).where("status = 'error'").groupBy("operation", F.coalesce("error_type", F.lit("unknown")).alias("error")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "operation", "error").limit(10)


@query("agg_platform_stats", "SELECT source, count(*) AS n, round(avg(salary_min), 4) AS low, round(avg(salary_max), 4) AS high, count(*) FILTER (WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL) AS paid FROM jds GROUP BY source", ("jds",))
def agg_platform_stats(spark, d):
    return S.jds(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("salary_min"), 4).alias("low"), F.round(F.avg("salary_max"), 4).alias("high"), F.count_if(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()).alias("paid"))


@query("agg_kb_stats", "SELECT 'postings' AS stat, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM part UNION ALL SELECT 'companies', NULL, count(DISTINCT p_brand) FROM part WHERE p_brand <> '' UNION ALL SELECT * FROM (SELECT 'skill', skill, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS skill FROM part) GROUP BY skill ORDER BY n DESC, skill LIMIT 10)")
def agg_kb_stats(spark, d):
    """How many postings and companies there are, and the ten most frequent skills."""
    rows = S.table(spark, d, "part").select(F.nullif("p_brand", F.lit("")).alias("company"), F.split("p_name", " ").alias("skills"))
    whole = rows.agg(F.count("*").alias("postings"), F.countDistinct("company").alias("companies"))
    counts = whole.select(F.explode(F.map_from_arrays(F.array(F.lit("postings"), F.lit("companies")), F.array("postings", "companies"))).alias("stat", "n")).select("stat", F.lit(None).cast("string").alias("name"), "n")
    skills = rows.select(F.explode("skills").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return counts.unionByName(skills.select(F.lit("skill").alias("stat"), "name", "n"))


def _common(tag, n):
    return f"SELECT '{tag}' AS kind, {tag} AS tag, count(*) AS n FROM ({scores.CLASSIFY_SQL}) WHERE {tag} IS NOT NULL GROUP BY {tag} ORDER BY n DESC, min(id) LIMIT {n}"


@query("topk_counter", f"SELECT * FROM ({_common('industry', 5)}) UNION ALL SELECT * FROM ({_common('position', 10)})")
def topk_counter(spark, d):
    """The five commonest industries and ten positions of what was classified, ties as first seen."""
    found = scores.classify(spark, d).where("industry is not null")
    both = found.select("id", F.explode(F.create_map(F.lit("industry"), "industry", F.lit("position"), "position")).alias("kind", "tag"))
    counts = both.groupBy("kind", "tag").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "first"))  # a row for each tag of the taxonomy
    return counts.withColumn("_n", order).where("_n <= CASE kind WHEN 'industry' THEN 5 ELSE 10 END").select("kind", "tag", "n")


@query("agg_language_backlog", "SELECT coalesce(language, 'none') AS language, count(*) AS n, count(*) FILTER (WHERE NOT translated) AS untranslated, count(*) FILTER (WHERE NOT translated AND retry_count >= 3) AS exhausted FROM chunks GROUP BY 1", ("chunks",))
def agg_language_backlog(spark, d):
    left = ~F.col("translated")
    return S.chunks(spark, d).groupBy(F.coalesce("language", F.lit("none")).alias("language")).agg(F.count("*").alias("n"), F.count_if(left).alias("untranslated"), F.count_if(left & (F.col("retry_count") >= 3)).alias("exhausted"))


@query("agg_translate_progress", "SELECT count(*) AS total, count(*) FILTER (WHERE translated) AS done, count(*) FILTER (WHERE NOT translated) AS pending, count(*) FILTER (WHERE translated) / count(*) AS ratio FROM chunks", ("chunks",))
def agg_translate_progress(spark, d):
    done = F.count_if("translated")
    return S.chunks(spark, d).agg(F.count("*").alias("total"), done.alias("done"), (F.count("*") - done).alias("pending"), rate(done, F.count("*")).alias("ratio"))


_CUT = "list_filter(c, lambda x, i: x IS NOT NULL AND list_position(c, x) = i)"


@query("agg_source_breakdown", f"SELECT query_id, list_sort(list_transform(list_distinct(p), lambda x: x || ':' || len(list_filter(p, lambda y: y = x)))) AS platforms, len({_CUT}) AS n_jds, {_CUT}[1:5] AS top_jds, list_transform(range(0, least(5, len(c))), lambda k: coalesce(c[k + 1], -1) || ' ' || p[k + 1] || ' ' || s[k + 1]) AS top_chunks FROM (SELECT query_id, list(CASE WHEN candidate % 9 > 0 THEN candidate END ORDER BY rank) AS c, list(CASE WHEN rank % 4 = 0 THEN 'other' ELSE source END ORDER BY rank) AS p, list(score ORDER BY rank) AS s FROM ranked GROUP BY query_id)", ("ranked",))
def agg_source_breakdown(spark, d):
    """What a result list rests on: hits by platform, distinct postings in order, and the first five hits."""
    hit = F.struct("rank", F.when(F.col("candidate") % 9 > 0, F.col("candidate")).alias("jd_id"), F.when(F.col("rank") % 4 > 0, F.col("source")).alias("platform"), "score")
    lists = S.ranked(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))  # a result list each
    platforms, jds = F.transform("hits", lambda h: F.coalesce(h["platform"], F.lit("other"))), F.array_distinct(F.array_compact(F.col("hits.jd_id")))
    counted = F.transform(F.array_distinct(platforms), lambda x: F.concat(x, F.lit(":"), F.size(F.filter(platforms, lambda y: y == x)).cast("string")))
    first = F.transform(F.slice("hits", 1, 5), lambda h: F.concat_ws(" ", F.coalesce(h["jd_id"], F.lit(-1)).cast("string"), F.coalesce(h["platform"], F.lit("other")), h["score"].cast("string")))
    return lists.select("query_id", F.array_sort(counted).alias("platforms"), F.size(jds).cast("bigint").alias("n_jds"), F.slice(jds, 1, 5).alias("top_jds"), first.alias("top_chunks"))


@query("agg_industries_covered", "SELECT user_id, list_sort(list(DISTINCT industry_tag)) AS industries FROM jds GROUP BY user_id", ("jds",))
def agg_industries_covered(spark, d):
    return S.jds(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set("industry_tag")).alias("industries"))


@query("agg_classify_report", f"WITH c AS ({scores.CLASSIFY_SQL}) SELECT 'layer' AS stat, coalesce(CAST(layer AS VARCHAR), 'none') AS name, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'industry', industry, count(*) AS n FROM c WHERE industry IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'position', position, count(*) AS n FROM c WHERE industry IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)")
def agg_classify_report(spark, d):
    """Texts by layer of the classifier, the five most frequent industries and the ten most frequent positions, from one pass."""
    one = lambda stat, name: F.struct(F.lit(stat).alias("stat"), name.alias("name"))
    said = F.array(one("layer", F.coalesce(F.col("layer").cast("string"), F.lit("none"))), one("industry", F.col("industry")), one("position", F.col("position")))
    counts = scores.classify(spark, d).select(F.inline(said)).where("name is not null").groupBy("stat", "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("stat").orderBy(F.desc("n"), "name"))  # names of a taxonomy
    most = F.when(F.col("stat") == "industry", 5).when(F.col("stat") == "position", 10).otherwise(10)
    return counts.withColumn("place", place).where(F.col("place") <= most).select("stat", "name", "n")


@query("agg_quality_histogram", "SELECT CASE WHEN quality_score IS NULL THEN 'unrated' WHEN quality_score >= 0.7 THEN '4' WHEN quality_score >= 0.5 THEN '3' WHEN quality_score >= 0.3 THEN '2' ELSE '1' END AS stars, count(*) AS n FROM jds GROUP BY 1", ("jds",))
def agg_quality_histogram(spark, d):
    return S.jds(spark, d).groupBy(T.stars(F.col("quality_score")).alias("stars")).agg(F.count("*").alias("n"))


#: A feedback form from an event, as an expression that both engines read.
_FORM = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'Step ' || (event_id % 5 + 1) END AS step, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 60 AS INT) END AS minutes, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'Step ' || (event_id % 4) || ': stuck' END AS blocked_a, CASE WHEN event_id % 9 = 0 THEN 'the end' END AS blocked_b, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 5 + 1 AS INT) END AS preserve_numbers, CAST(event_id % 4 + 1 AS INT) AS natural_rewrite, CASE WHEN event_id = 17 THEN 4 END AS no_fabrication, CAST(NULL AS INT) AS rewrite_reason_helpful, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS intent"
#: What is rated.
_RATED = ("preserve_numbers", "natural_rewrite", "no_fabrication", "rewrite_reason_helpful")
_FEEDBACK = f"""WITH f AS (SELECT {_FORM} FROM events), v AS (
  SELECT 'step' AS stat, coalesce(step, '未知') AS name, 1.0::DOUBLE AS v FROM f UNION ALL SELECT 'intent', coalesce(intent, '未知'), 1 FROM f
  UNION ALL SELECT 'blocked', trim(split_part(x, ':', 1)), 1 FROM (SELECT unnest([blocked_a, blocked_b]) AS x FROM f) WHERE x IS NOT NULL
  UNION ALL SELECT 'finished', 'all', CASE WHEN step = 'Step 5' THEN 1 ELSE 0 END FROM f UNION ALL SELECT 'minutes', 'all', minutes FROM f
  {" ".join(f"UNION ALL SELECT 'quality', '{k}', {k} FROM f" for k in _RATED)})
  SELECT stat, name, count(v) AS n, round(coalesce(avg(v), 0), 2) AS mean, round(CASE WHEN count(v) < 2 THEN 0 ELSE stddev_samp(v) END, 2) AS deviation FROM v GROUP BY stat, name"""


@query("agg_feedback", _FEEDBACK)
def agg_feedback(spark, d):
    """Counts of steps, intents and blocked steps, the share that finished, minutes and ratings, from one pass."""
    one = lambda stat, name, v: F.struct(F.lit(stat).alias("stat"), name.alias("name"), v.cast("double").alias("v"))
    all_, step = F.lit("all"), F.coalesce("step", F.lit("未知"))
    rows = S.table(spark, d, "events").selectExpr(*S.fields(_FORM))
    blocked = F.transform(F.array_compact(F.array("blocked_a", "blocked_b")), lambda x: one("blocked", F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.lit(1)))
    said = F.array(one("step", step, F.lit(1)), one("intent", F.coalesce("intent", F.lit("未知")), F.lit(1)), one("finished", all_, F.coalesce((F.col("step") == "Step 5").cast("int"), F.lit(0))), one("minutes", all_, F.col("minutes")), *[one("quality", F.lit(k), F.col(k)) for k in _RATED])
    values = rows.select(F.inline(F.concat(said, blocked)))
    return values.groupBy("stat", "name").agg(F.count("v").alias("n"), F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 2).alias("deviation"))


@query("agg_match_stats", "SELECT user_id, count(*) FILTER (WHERE score >= 80) AS high, count(*) FILTER (WHERE score >= 70 AND score < 80) AS medium, count(*) FILTER (WHERE score < 70) AS low, round(avg(score), 4) AS mean, CASE WHEN avg(score) >= 80 THEN 1.0::DOUBLE WHEN avg(score) >= 70 THEN 0.8::DOUBLE WHEN avg(score) >= 50 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS quality FROM matches GROUP BY user_id", ("matches",))
def agg_match_stats(spark, d):
    s = F.col("score")
    quality = F.when(F.avg(s) >= 80, 1.0).when(F.avg(s) >= 70, 0.8).when(F.avg(s) >= 50, 0.6).otherwise(0.4)
    return S.matches(spark, d).groupBy("user_id").agg(F.count_if(s >= 80).alias("high"), F.count_if((s >= 70) & (s < 80)).alias("medium"), F.count_if(s < 70).alias("low"), F.round(F.avg(s), 4).alias("mean"), quality.alias("quality"))


_FOUND = "source, CASE WHEN id % 4 > 0 THEN title END AS title, CASE WHEN id % 6 = 0 THEN '' ELSE company END AS company, CASE WHEN id % 9 > 0 THEN url END AS url, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 0 ELSE salary_min END AS pay"


@query("agg_search_quality", f"SELECT source, round((0.5 + 0.3 * avg(CAST(coalesce(title, '') <> '' AND coalesce(company, '') <> '' AND coalesce(url, '') <> '' AS INTEGER)) + 0.2 * avg(CAST(coalesce(pay, 0) <> 0 AS INTEGER))) * CASE WHEN count(*) < 5 THEN 0.7 ELSE 1 END, 4) AS quality FROM (SELECT {_FOUND} FROM jds) GROUP BY source", ("jds",))
def agg_search_quality(spark, d):
    """Postings with title, company and address, and those with a salary; few results count less."""
    share = lambda c: F.avg(c.cast("int"))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    raw = 0.5 + 0.3 * share(said("title") & said("company") & said("url")) + 0.2 * share(F.coalesce("pay", F.lit(0)) != 0)
    return S.jds(spark, d).selectExpr(*S.fields(_FOUND)).groupBy("source").agg(F.round(raw * F.when(F.count("*") < 5, 0.7).otherwise(1.0), 4).alias("quality"))


@query("agg_platform_perf", "SELECT platform, round(ok / n * 0.4 + least(results / n / 20, 1) * 0.3 + least(results / n / greatest(seconds, 1) / 2, 1) * 0.3, 4) AS score FROM (SELECT event_type AS platform, count(*) AS n, count(*) FILTER (WHERE value > 10) AS ok, coalesce(sum(user_id % 40) FILTER (WHERE value > 10), 0) AS results, coalesce(sum(value / 1000000) FILTER (WHERE value > 10), 0) AS seconds FROM events GROUP BY 1)")
def agg_platform_perf(spark, d):
    """Searches that succeeded, results of a search, and results a second, of each platform."""
    ok, one = F.col("value") > 10, F.lit(1.0)
    of = S.table(spark, d, "events").groupBy(F.col("event_type").alias("platform")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.sum(F.when(ok, F.col("user_id") % 40).otherwise(0)).alias("results"), F.sum(F.when(ok, F.col("value") / 1000000).otherwise(0.0)).alias("seconds"))
    mean = F.col("results") / F.col("n")
    return of.select("platform", F.round(F.col("ok") / F.col("n") * 0.4 + F.least(mean / 20, one) * 0.3 + F.least(mean / F.greatest("seconds", one) / 2, one) * 0.3, 4).alias("score"))


@query("agg_apply_stats", "SELECT user_id, round(rate, 4) AS success_rate, round(mean, 4) AS mean, CASE WHEN n > 5 AND rate < 0.5 THEN 'conservative' WHEN mean >= 80 AND top >= n * 0.5 THEN 'aggressive' WHEN mean >= 70 THEN 'balanced' ELSE 'conservative' END AS strategy, CASE WHEN rate >= 0.8 THEN 1.0::DOUBLE WHEN rate >= 0.5 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM (SELECT user_id, count(*) AS n, avg(CAST(applied AS INTEGER)) AS rate, avg(score + 50) AS mean, count(*) FILTER (WHERE score + 50 >= 85) AS top FROM matches GROUP BY user_id)", ("matches",))
def agg_apply_stats(spark, d):
    """Success and scores of a user's applications, and the strategy: history first, then the scores."""
    score = F.col("score") + 50
    of = S.matches(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("applied").cast("int")).alias("rate"), F.avg(score).alias("mean"), F.count_if(score >= 85).alias("top"))
    rate, mean = F.col("rate"), F.col("mean")
    strategy = F.when((F.col("n") > 5) & (rate < 0.5), "conservative").when((mean >= 80) & (F.col("top") >= F.col("n") * 0.5), "aggressive").when(mean >= 70, "balanced").otherwise("conservative")
    return of.select("user_id", F.round(rate, 4).alias("success_rate"), F.round(mean, 4).alias("mean"), strategy.alias("strategy"), F.when(rate >= 0.8, 1.0).when(rate >= 0.5, 0.8).otherwise(0.5).alias("quality"))


@query("agg_monitor_report", "SELECT model, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(total_tokens) / 1000 * 0.002, 6) AS cost, round(count(*) / greatest(sum(latency_ms) / 1000, 1), 6) AS per_second FROM llm_calls GROUP BY model", ("llm_calls",))
def agg_monitor_report(spark, d):
    return S.llm_calls(spark, d).groupBy("model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("total_tokens") / 1000 * 0.002, 6).alias("cost"), F.round(F.count("*") / F.greatest(F.sum("latency_ms") / 1000, F.lit(1.0)), 6).alias("per_second"))


@query("agg_one_pass", "SELECT count(*) AS n, count(human) AS rated, round(avg(CAST(human AS INTEGER)), 4) AS human_rate, round(avg(CAST(score >= 3 AS INTEGER)), 4) AS judge_rate, round(avg(CAST(is_mock AS INTEGER)), 4) AS mock_rate, round(avg(score), 2) AS clarity, round(avg(score2), 2) AS truth, count(*) >= 50 AND count(human) = count(*) AND round(avg(CAST(is_mock AS INTEGER)), 4) < 0.03 AS valid FROM (SELECT *, CASE WHEN candidate % 3 > 0 THEN candidate % 3 = 1 END AS human FROM ranked)", ("ranked",))
def agg_one_pass(spark, d):
    rows = S.ranked(spark, d).withColumn("human", F.when(F.col("candidate") % 3 > 0, F.col("candidate") % 3 == 1))
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    valid = (F.count("*") >= 50) & (F.count("human") == F.count("*")) & (share(F.col("is_mock")) < 0.03)
    return rows.agg(F.count("*").alias("n"), F.count("human").alias("rated"), share(F.col("human")).alias("human_rate"), share(F.col("score") >= 3).alias("judge_rate"), share(F.col("is_mock")).alias("mock_rate"), F.round(F.avg("score"), 2).alias("clarity"), F.round(F.avg("score2"), 2).alias("truth"), valid.alias("valid"))


@query("agg_type_distribution", "SELECT chunk_type, count(*) AS n, coalesce(max(chunk_index), -1) + 1 AS next_index FROM chunks GROUP BY chunk_type", ("chunks",))
def agg_type_distribution(spark, d):
    return S.chunks(spark, d).groupBy("chunk_type").agg(F.count("*").alias("n"), (F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).alias("next_index"))


_UPGRADED = "SELECT id, CASE WHEN id % 4001 = 1 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN id % 4001 = 2 THEN NULL ELSE status END AS status, updated_at, CASE WHEN id % 4001 = 3 THEN total + 1 ELSE total END AS total FROM drafts WHERE id % 4001 <> 4"


@query("agg_draft_preservation", f"SELECT b.status, count(*) AS n, count(*) FILTER (WHERE same) AS kept, count(*) FILTER (WHERE NOT same) AS lost, coalesce(list_sort(list(b.id) FILTER (WHERE NOT same))[1:5], []) AS lost_ids, greatest(0, 10 - 2 * count(*) FILTER (WHERE NOT same))::DOUBLE AS score FROM (SELECT b.status, b.id, a.id IS NOT NULL AND b.user_id IS NOT DISTINCT FROM a.user_id AND b.status IS NOT DISTINCT FROM a.status AND b.updated_at IS NOT DISTINCT FROM a.updated_at AND b.total IS NOT DISTINCT FROM a.total AS same FROM drafts b LEFT JOIN ({_UPGRADED}) a ON a.id = b.id) b GROUP BY b.status", ("drafts",))
def agg_draft_preservation(spark, d):
    """Drafts before and after an upgrade that changes or drops some: every column is compared."""
    before, k = S.drafts(spark, d), F.col("id") % 4001
    after = before.where(k != 4).select("id", F.when(k == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), F.when(k != 2, F.col("status")).alias("status"), "updated_at", F.when(k == 3, F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    return M.preserved(before, after, "id", "status")


# -- windows ------------------------------------------------------------------------------------------


@query("win_first_per_key", "SELECT url, page_id FROM (SELECT split_part(split_part(url, '?', 1), '#', 1) AS url, page_id FROM pages) WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def win_first_per_key(spark, d):
    """First row of each key, by input order; falsy keys go."""
    from ..operators.store import first_by

    rows = S.table(spark, d, "pages").select(T.strip_url(F.col("url")).alias("url"), "page_id").where(~T.blank(F.col("url")))
    return first_by(rows, ["url"], F.asc("page_id"))


@query("win_prev_next_context", "SELECT conv_id, turn, coalesce(lag(substr(text, 1, 20)) OVER w, 'none') AS before, coalesce(lead(substr(text, 1, 20)) OVER w, 'none') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win_prev_next_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    head = F.substring("text", 1, 20)
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag(head).over(w), F.lit("none")).alias("before"), F.coalesce(F.lead(head).over(w), F.lit("none")).alias("after"))


@query("neighbor_join", "SELECT c.id, p.id AS before, n.id AS after FROM chunks c LEFT JOIN chunks p ON p.jd_id = c.jd_id AND p.chunk_index = c.chunk_index - 1 LEFT JOIN chunks n ON n.jd_id = c.jd_id AND n.chunk_index = c.chunk_index + 1", ("chunks",))
def neighbor_join(spark, d):
    w = Window.partitionBy("jd_id").orderBy("chunk_index")
    return S.chunks(spark, d).select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


_COST = r"CAST(floor(len(regexp_extract_all(text, '[\p{L}\p{N} .,!?\-]')) * 0.25 + (length(text) - len(regexp_extract_all(text, '[\p{L}\p{N} .,!?\-]'))) * 0.5) AS BIGINT)"


@query("win_token_budget", f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 300")
def win_token_budget(spark, d):
    """Newest turns whose tokens together fit; sums only rise, so this stops at the first that doesn't."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.sum(T.estimate_tokens(F.col("text"))).over(w).alias("used")).where("used <= 300")


@query("win_keep_recent", "SELECT conv_id, turn, 'recent' AS why FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10 UNION ALL SELECT conv_id, turn, 'last of important' FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5 UNION ALL SELECT conv_id, turn, 'important' FROM conversations WHERE role = 'system'")
def win_keep_recent(spark, d):
    """Both strategies: the last ten turns; or important turns and the last five, where a turn may be both."""
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("n"))
    why = F.array_compact(F.array(F.when(F.col("n") <= 10, "recent"), F.when(F.col("n") <= 5, "last of important"), F.when(F.col("role") == "system", "important")))
    return rows.select("conv_id", "turn", F.explode(why).alias("why"))


@query("win_last_n_rate", "SELECT event_id, avg(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM events")
def win_last_n_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return S.table(spark, d, "events").select("event_id", F.avg((F.col("event_type") != "error").cast("int")).over(w).alias("rate"))


ADAPTIVE_SQL = "WITH RECURSIVE e AS (SELECT user_id, avg(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, 0::BIGINT AS n, 2.0::DOUBLE AS delay FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT r.user_id, e.n, CASE WHEN e.rate < 0.8 THEN least(60, r.delay * 1.5) WHEN e.rate > 0.95 AND r.delay > 1 THEN greatest(1, r.delay * 0.9) ELSE r.delay END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, round(arg_max(delay, n), 6) AS delay FROM r GROUP BY user_id"


@query("win_adaptive_delay", ADAPTIVE_SQL)
def win_adaptive_delay(spark, d):
    """Delay after all outcomes of a user, in order: times 1.5 while under 0.8 of the last ten succeed,
    times 0.9 while over 0.95 do, within 1 and 60.

    Each step is a clamped scaling, and these compose: a user's steps are folded by day, and then the
    days, so that no user's outcomes are in one row.
    """
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    events = S.table(spark, d, "events").select("user_id", "ts", "event_id", F.avg((F.col("event_type") != "error").cast("int")).over(last).alias("rate"))
    factor = F.when(F.col("rate") < 0.8, 1.5).when(F.col("rate") > 0.95, 0.9).otherwise(1.0)
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id", factor.alias("m"), F.when(factor < 1, 1.0).otherwise(0.0).alias("low"), F.when(factor > 1, 60.0).otherwise(float("inf")).alias("high"))))
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(M.clamped_scaling(steps).alias("x")).select("user_id", "day", "x.*")
    whole = days.groupBy("user_id").agg(M.clamped_scaling(F.sort_array(F.collect_list(F.struct("day", "m", "low", "high")))).alias("x"))  # a row for each day
    return whole.select("user_id", F.round(F.least(F.greatest(2.0 * F.col("x.m"), "x.low"), "x.high"), 6).alias("delay"))


@query("win_form_rotation", "SELECT id, CASE row_number() OVER (PARTITION BY source ORDER BY id) % 3 WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS form FROM jds", ("jds",))
def win_form_rotation(spark, d):
    n = F.col("number") % 3
    rows = M.numbered(S.jds(spark, d).select("source", "id"), "source", F.floor(F.col("id") / 10_000), "id")
    return rows.select("id", F.when(n == 1, "short").when(n == 2, "medium").otherwise("long").alias("form"))


@query("parent_child_closure", "WITH RECURSIVE t AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM tree) THEN parent_id END AS parent_id FROM tree), c AS (SELECT id, id AS root, 0 AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, c.root, c.depth + 1 FROM t JOIN c ON t.parent_id = c.id) SELECT id, root, depth FROM c".replace("WITH RECURSIVE t AS", ", t AS"), ("tree",), True)
def parent_child_closure(spark, d):
    """Root and depth of every version; one whose parent is missing is a root."""
    return store.closure(S.tree(spark, d))


_GROUPED = """, t AS (SELECT *, CASE WHEN parent_id IN (SELECT id FROM tree) THEN parent_id END AS up FROM tree), c AS (SELECT id, id AS root FROM t WHERE up IS NULL UNION ALL SELECT t.id, c.root FROM t JOIN c ON t.up = c.id),
  g AS (SELECT t.user_id, c.root, bool_or(is_primary) AS main, max(updated_at) AS newest, arg_min(t.id, {'v': coalesce(version, 1), 'i': t.id}) AS base FROM t JOIN c USING (id) GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY main DESC, newest DESC, root) AS group_no FROM g)
  SELECT t.id, t.user_id, CASE WHEN main THEN n.root ELSE base END AS root_id, CAST(group_no AS INTEGER) AS group_no, CAST(row_number() OVER (PARTITION BY c.root ORDER BY coalesce(version, 1), updated_at, t.id) AS INTEGER) AS place FROM t JOIN c USING (id) JOIN n ON n.root = c.root AND n.user_id = t.user_id"""


@query("win_version_group_order", _GROUPED, ("tree",), True)
def win_version_group_order(spark, d):
    """Versions by group: a user's primary group first, the others by their newest version; within a group by version."""
    rows = S.tree(spark, d).withColumn("version", F.coalesce("version", F.lit(1)))
    rows = rows.join(store.closure(rows).select("id", "root"), "id")
    groups = rows.groupBy("user_id", "root").agg(F.bool_or("is_primary").alias("main"), F.max("updated_at").alias("newest"), F.min(F.struct("version", "id")).alias("first"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("main"), F.desc("newest"), "root"))
    listed = groups.select("user_id", "root", F.when(F.col("main"), F.col("root")).otherwise(F.col("first.id")).alias("root_id"), number.alias("group_no"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("version", "updated_at", "id"))
    return rows.join(listed, ["user_id", "root"]).select("id", "user_id", "root_id", "group_no", place.alias("place"))


@query("batch_sort_desc", "SELECT user_id, id, score FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) <= 20) ORDER BY score DESC, id", ("matches",))
def batch_sort_desc(spark, d):
    """Only the first twenty of a user are scored in the sampling strategy; then by score."""
    first = S.matches(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("id"))).where("n <= 20")
    return first.select("user_id", "id", "score").orderBy(F.desc("score"), "id")


# -- sets -----------------------------------------------------------------------------------------------

_WANTED = "['Brand#1', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13']"


def wanted():
    return F.array(*[F.lit(f"Brand#{n}") for n in (1, 10, 11, 12, 13)])


@query("set_intersect_skills", f"SELECT user_id, list_sort(list_intersect(skills, {_WANTED})) AS matched FROM skills", ("skills",))
def set_intersect_skills(spark, d):
    return S.skills(spark, d).select("user_id", F.array_sort(F.array_intersect("skills", wanted())).alias("matched"))


@query("set_diff_skills", f"SELECT user_id, list_sort(list_filter({_WANTED}, lambda x: NOT list_contains(skills, x))) AS missing FROM skills", ("skills",))
def set_diff_skills(spark, d):
    return S.skills(spark, d).select("user_id", F.array_sort(F.array_except(wanted(), "skills")).alias("missing"))


@query("failed_ids_set", "SELECT id, retry_count + CASE WHEN id IN (SELECT item_id FROM benchmark) THEN 1 ELSE 0 END AS retry_count FROM chunks", ("chunks",))
def failed_ids_set(spark, d):
    failed = S.table(spark, d, "benchmark").selectExpr("item_id AS id", "1 AS one").distinct()
    return S.chunks(spark, d).join(failed, "id", "left").select("id", (F.col("retry_count") + F.coalesce("one", F.lit(0))).alias("retry_count"))
