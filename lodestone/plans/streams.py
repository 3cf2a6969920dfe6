"""Streams over the event log, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..sources import files, folder
from ..sources import frames as S
from ..streaming import logs
from .aggregates import ADAPTIVE_SQL
from .registry import query
from .texts import CLEAN_SQL


def path(d):
    """A pattern, as a stream's source may be one file or a folder."""
    return f"{d}/event[s].parquet"


@query("stream_log_append", "SELECT id, created_at, operation, status, total_tokens FROM llm_calls", ("llm_calls",))
def stream_log_append(spark, d):
    return logs.append_log(spark, path(d)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("stream_daily_usage", "SELECT CAST(created_at AS DATE) AS day, user_id, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM llm_calls GROUP BY 1, 2", ("llm_calls",))
def stream_daily_usage(spark, d):
    return logs.daily_usage(spark, path(d))


@query("stream_lockout", "SELECT user_id, w + INTERVAL 15 MINUTE AS until, count(*) AS failures FROM (SELECT user_id, unnest(generate_series(date_trunc('minute', created_at) - INTERVAL 14 MINUTE, date_trunc('minute', created_at), INTERVAL 1 MINUTE)) AS w FROM llm_calls WHERE status = 'error') GROUP BY 1, 2 HAVING count(*) >= 2", ("llm_calls",))
def stream_lockout(spark, d):
    return logs.lockouts(spark, path(d), 2).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("stream_rate_state", ADAPTIVE_SQL)
def stream_rate_state(spark, d):
    return logs.adaptive_delay(spark, path(d)).withColumn("delay", F.round("delay", 6))


@query("stream_domain_block", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND (b.ts < e.ts OR b.ts = e.ts AND b.event_id < e.event_id) AND e.ts < b.ts + INTERVAL 30 MINUTE)")
def stream_domain_block(spark, d):
    return logs.blocked(spark, path(d))


@query("stream_user_store", "SELECT user_id, CAST(user_id % 8 AS INTEGER) AS shard, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1, 2")
def stream_user_store(spark, d):
    """A sink into a stored table in which each batch counts once."""
    return logs.user_store(spark, path(d)).read()


@query("stream_incremental_index", "SELECT event_id, CASE WHEN ok THEN 'done' ELSE 'given up' END AS state, CAST(tries AS INTEGER) AS retry_count FROM (SELECT event_id, len(list_filter(range(event_id % 5, 3), lambda k: (event_id + k) % 4 > 1)) > 0 AS ok, coalesce(list_filter(range(event_id % 5, 3), lambda k: (event_id + k) % 4 > 1)[1], 3) AS tries FROM events WHERE event_id % 5 < 3)")
def stream_incremental_index(spark, d):
    """What is left to index is tried until it is done, three times at most."""
    return logs.incremental_index(spark, path(d), lambda rows: (F.col("event_id") + F.col("retry_count")) % 4 > 1)


@query("scan_embedding_blob", "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN embedding WHEN 1 THEN [1.5, 2.5]::FLOAT[] END AS embedding FROM embeddings")
def scan_embedding_blob(spark, d):
    """Vectors from bytes, from legacy text, and from neither."""
    blob = F.when(F.col("vec_id") % 3 == 0, files.encode_vectors("embedding")).when(F.col("vec_id") % 3 == 1, F.encode(F.lit("[1.5, 2.50]"), "UTF-8")).otherwise(F.encode(F.lit("no vector"), "UTF-8"))
    return S.table(spark, d, "embeddings").select("vec_id", files.decode_vectors(blob).alias("embedding"))


@query("sink_embedding_blob", "SELECT vec_id, len(embedding) * 4 AS n_bytes FROM embeddings")
def sink_embedding_blob(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", F.octet_length(files.encode_vectors("embedding")).cast("bigint").alias("n_bytes"))


@query("sink_jsonl", "SELECT event_id, user_id, event_type FROM events")
def sink_jsonl(spark, d):
    """Records written as JSON lines and read back by schema."""
    out = files.work_path(spark, "jsonl")
    files.write_jsonl(S.table(spark, d, "events").select("event_id", "user_id", "event_type"), out)
    return files.read_jsonl(spark, out, "event_id bigint, user_id bigint, event_type string")


@query("scan_jsonl", "SELECT event_id, event_id % 10 = 0 AS bad FROM events WHERE event_id % 7 > 0")
def scan_jsonl(spark, d):
    """JSON lines with blank and malformed ones, which are reported."""
    out = files.work_path(spark, "lines")
    e = F.col("event_id")
    line = F.when(e % 7 == 0, "").when(e % 10 == 0, F.concat(F.lit('{"event_id": '), e, F.lit(" oops"))).otherwise(F.concat(F.lit('{"event_id": '), e, F.lit("}")))
    S.table(spark, d, "events").select(line).write.text(out)
    rows = files.read_jsonl(spark, out, "event_id bigint", "report")
    id_ = F.coalesce("event_id", F.regexp_extract("_corrupt_record", r": (\d+)", 1).try_cast("bigint"))
    return rows.select(id_.alias("event_id"), F.col("_corrupt_record").isNotNull().alias("bad"))


@query("sink_json_report", "SELECT 'baseline' AS key, CAST(count(*) AS VARCHAR) AS n, CAST(max(event_id) AS VARCHAR) AS top FROM events UNION ALL SELECT 'other', '7', NULL")
def sink_json_report(spark, d):
    """A summary written as JSON, and merged under its key into an older progress report."""
    old, out = files.work_path(spark, "progress"), files.work_path(spark, "report")
    spark.range(1).select(F.lit('{"baseline": {"n": 1}, "other": {"n": 7}}').alias("v")).coalesce(1).write.text(old)
    files.write_report(S.table(spark, d, "events").agg(F.count("*").alias("n"), F.max("event_id").alias("top")), out)
    summary = spark.read.schema("n bigint, top bigint").json(out)
    merged = files.merge_report(spark, old, "baseline", summary)
    return merged.select(F.explode(F.from_json("report", "map<string, struct<n: string, top: string>>")).alias("key", "v")).select("key", "v.n", "v.top")


#: A document's name: by number, of a suffix that goes by it.
_NAME = "'doc_' || lpad(CAST(doc_id AS {0}), 12, '0') || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.docx' WHEN 3 THEN '.rst' ELSE '.dat' END"


@query("scan_json_dir", "SELECT doc_id AS id, source, text FROM documents WHERE doc_id % 3 > 0 ORDER BY id DESC LIMIT 100")
def scan_json_dir(spark, d):
    """One file for each object, the last 100 names first; files that don't fit the pattern are left alone."""
    out = files.work_path(spark, "objects")
    kind = F.when(F.col("doc_id") % 3 > 0, "jd_").otherwise("resume_")
    rows = S.table(spark, d, "documents").select(F.concat(kind, F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json")).alias("file_name"), F.to_json(F.struct(F.col("doc_id").alias("id"), "source", "text"), {"ignoreNullFields": "false"}).cast("binary").alias("content"))
    folder.write_folder(rows, out)
    return files.read_json_dir(spark, out, "jd_*.json", "id bigint, source string, text string", 100).select("id", "source", "text")


@query("scan_text_file", f"SELECT name AS file_name, suffix, CASE WHEN suffix <> 'dat' THEN {CLEAN_SQL} END AS text FROM (SELECT {_NAME.format('VARCHAR')} AS name, lower(split_part({_NAME.format('VARCHAR')}, '.', 2)) AS suffix, coalesce(text, '') AS text FROM documents)")
def scan_text_file(spark, d):
    """A folder of all documents as plain and .docx files, read by their suffix; one is unknown."""
    out = files.work_path(spark, "texts")
    rows = S.table(spark, d, "documents").selectExpr(f"{_NAME.format('STRING')} AS file_name", "coalesce(text, '') AS text")
    folder.write_folder(rows.select("file_name", F.when(F.col("file_name").endswith(".docx"), files.encode_docx("text")).otherwise(F.encode("text", "UTF-8")).alias("content")), out)
    return folder.read_folder(spark, out, "doc_*").select("file_name", "suffix", clean_text(F.col("text")).alias("text"))
