"""Retrieval, ranking evaluation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import measure as M
from ..operators import retrieval as R
from ..operators import store
from ..operators import trigrams as G
from ..operators import vectors as V
from ..sources import frames as S
from ..sources.files import work_path, work_table
from .registry import query

#: The query set: rows whose id is divisible by this.
EVERY = 50
_Q = "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SIM = f"SELECT c.id, c.jd_id, c.chunk_index, c.chunk_type, q.query_id, {_DOT.format(a='c.embedding', b='q.vector')} / (sqrt({_DOT.format(a='c.embedding', b='c.embedding')}) * sqrt({_DOT.format(a='q.vector', b='q.vector')})) AS similarity FROM chunks c, ({_Q}) q"
_W = "CASE chunk_type WHEN 'responsibility' THEN 1.2::DOUBLE WHEN 'requirement' THEN 1.3::DOUBLE WHEN 'overview' THEN 0.8::DOUBLE WHEN 'nice_to_have' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


def queries(spark, d):
    return S.table(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).selectExpr("vec_id AS query_id", "embedding AS vector")


def similar(spark, d, k=None, by=None, weight=None, where=None):
    rows = S.chunks(spark, d)
    rows = rows.where(where) if where else rows
    rows = rows.withColumns({"required": F.col("chunk_type") == "requirement", "useful": F.col("chunk_type").isin("requirement", "responsibility"), "full": F.col("chunk_type") == "full", "weight": R.type_weight(F.col("chunk_type"))})
    return R.similar(rows.select("id", "jd_id", "chunk_index", "chunk_type", "required", "useful", "full", "weight", "embedding"), queries(spark, d), k, by, weight)


def tagged(spark, d, df):
    jds = S.jds(spark, d).select(F.col("id").alias("jd_id"), "industry_tag", "position_tag", "title")
    return df.join(jds, "jd_id", "left")


@query("topk_cosine", f"SELECT query_id, id, round(similarity, 4) AS similarity FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10", ("chunks",))
def topk_cosine(spark, d):
    return similar(spark, d, 10).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("topk_vec0_postfilter", f"SELECT query_id, id, round(similarity, 4) AS similarity FROM (SELECT * FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 200) WHERE chunk_type = 'requirement' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10", ("chunks",))
def topk_vec0_postfilter(spark, d):
    """The two-stage form: over-fetch, then filter, so fewer than k may be left."""
    near = similar(spark, d, max(20 * 10, 200)).where("chunk_type = 'requirement'")
    return R.top(near, 10).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


def indexed(spark, d):
    return V.build_index(S.chunks(spark, d).select("id", "chunk_type", "user_id", "embedding"), work_path(spark, "vectors"))


@query("topk_vec_index")
def topk_vec_index(spark, d):
    """From an index of cells, of which each query reads a few; its recall is held against the scan in tests."""
    return V.search_index(indexed(spark, d), queries(spark, d), 10).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("topk_vec_index_exact", f"SELECT query_id, id, round(similarity, 4) AS similarity FROM ({_SIM}) WHERE chunk_type = 'requirement' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10", ("chunks",))
def topk_vec_index_exact(spark, d):
    """From the index, with a filter, and on to every cell that could hold a better row."""
    return V.search_index(indexed(spark, d), queries(spark, d), 10, where="chunk_type = 'requirement'", exact=True).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


def _retrieved(k, least, industry):
    return f"""SELECT query_id, id, chunk_type, round(similarity, 4) AS similarity, round(ranked, 4) AS ranked_score FROM (
      SELECT *, similarity * {_W} * CASE WHEN industry_tag = '{industry}' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS ranked FROM (
        SELECT * FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= {3 * k}) s LEFT JOIN (SELECT id AS jd, industry_tag FROM jds) j ON j.jd = s.jd_id
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ranked DESC, id) <= {k}) WHERE similarity >= {least}"""


@query("retrieve", _retrieved(5, 0.2, "src1"), ("chunks", "jds"))
def retrieve(spark, d):
    """Candidates by cosine, soft weights of type and industry, the top k, then the threshold."""
    near = similar(spark, d, R.candidates_wanted(5, False))
    return R.weighted(tagged(spark, d, near), 5, 0.2, "src1").select("query_id", "id", "chunk_type", F.round("similarity", 4).alias("similarity"), F.round("ranked_score", 4).alias("ranked_score"))


@query("topk_weighted", f"SELECT query_id, id, round(similarity * {_W}, 4) AS ranked_score FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity * {_W} * 1.0 DESC, id) <= 20", ("chunks",))
def topk_weighted(spark, d):
    return R.weighted(similar(spark, d, 20, weight="weight"), 20, -1.0).select("query_id", "id", F.round("ranked_score", 4).alias("ranked_score"))


_LOGIT = "len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(coalesce({1}, '')), '\\s+'), lambda x: x <> '')))) - 2.0::DOUBLE"
_CHUNKS = f"SELECT c.*, t.chunk_text, q.chunk_text AS query_text FROM ({{}}) c LEFT JOIN chunk_texts t ON t.id = c.id LEFT JOIN chunk_texts q ON q.id = c.query_id"


def _reranked(k, rows, boost="1.0::DOUBLE"):
    best = f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= {max(5 * k, 50)}"
    scored = f"SELECT *, {_LOGIT.format('query_text', 'chunk_text')} AS logit FROM ({_CHUNKS.format(best)})"
    cut = f"SELECT *, 0.7::DOUBLE * round(CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END, 4) + (1 - 0.7::DOUBLE) * (similarity * {_W} * {boost}) AS ranked FROM ({scored}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, id) <= {max(4 * k, 20)}"
    return f"SELECT query_id, id, chunk_type, round(similarity, 4) AS similarity, round(ranked, 4) AS ranked_score FROM ({cut}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ranked DESC, id) <= {k}"


def with_texts(spark, d):
    """Chunks with their texts and tags, and queries with theirs."""
    texts = S.chunk_texts(spark, d)
    jds = S.jds(spark, d).select(F.col("id").alias("jd_id"), "industry_tag", "position_tag")
    chunks = S.chunks(spark, d).join(texts, "id", "left").join(jds, "jd_id", "left").select("id", "jd_id", "chunk_index", "chunk_type", "user_id", "position_tag", "industry_tag", "chunk_text", "embedding")
    asked = queries(spark, d).join(texts.select(F.col("id").alias("query_id"), F.col("chunk_text").alias("query_text")), "query_id", "left")
    return chunks, asked


@query("topk_rerank", _reranked(10, _SIM), ("chunks", "chunk_texts"))
def topk_rerank(spark, d):
    """A scorer's logits lead, soft weights follow; the scorer is a pandas UDF of any model, here of shared words."""
    chunks, asked = with_texts(spark, d)
    return R.retrieve(chunks, asked, 10, score=R.scorer(R.shared_words))


_FILTERED = f"SELECT s.*, j.industry_tag FROM ({_SIM}) s JOIN chunks c ON c.id = s.id JOIN (SELECT id AS jd, industry_tag, position_tag FROM jds) j ON j.jd = s.jd_id WHERE c.user_id = 'u3' AND j.position_tag = 'p2' AND s.query_id % 100 = 0"
_FALLBACK = "SELECT q.query_id, c.id, c.chunk_type, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS ranked_score FROM (SELECT vec_id AS query_id, split_part(text, ' ', 1) AS asked FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 50) q, (SELECT c.id, c.chunk_index, c.chunk_type, t.chunk_text FROM chunks c JOIN chunk_texts t ON t.id = c.id JOIN (SELECT id AS jd, position_tag FROM jds) j ON j.jd = c.jd_id WHERE c.user_id = 'u3' AND j.position_tag = 'p2') c WHERE asked <> '' AND contains(lower(c.chunk_text), lower(asked)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_index, c.id) <= 3"


@query("retrieve_filtered", f"SELECT * FROM ({_reranked(3, _FILTERED, "CASE WHEN industry_tag = 'src1' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END")}) UNION ALL SELECT * FROM ({_FALLBACK})", ("chunks", "chunk_texts", "jds"))
def retrieve_filtered(spark, d):
    """All filters, an industry and a scorer; queries without a vector search by text."""
    chunks, asked = with_texts(spark, d)
    asked = asked.withColumns({"vector": F.when(F.col("query_id") % 100 == 0, F.col("vector")), "query_text": F.when(F.col("query_id") % 100 == 0, F.col("query_text")).otherwise(F.split_part("query_text", F.lit(" "), F.lit(1)))})
    return R.retrieve(chunks, asked, 3, user_id="u3", position="p2", industry="src1", score=R.scorer(R.shared_words))


_WORDS2 = "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)"


@query("topk_like", f"SELECT item_id AS query_id, doc_id AS id FROM (SELECT b.item_id, d.doc_id FROM documents d, (SELECT item_id, {_WORDS2} AS said FROM benchmark WHERE item_id % 50 = 0) b WHERE contains(lower(d.text), lower(b.said))) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 5")
def topk_like(spark, d):
    """Substring search of a query set's texts by trigrams, first matches by number."""
    asked = S.table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("query_text"))
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = G.search(G.build_trigrams(rows, work_path(spark, "trigrams")), rows, asked, ["text"])
    return R.top(found.select("query_id", "id"), 5, "query_id").select("query_id", "id")


_ASKED = "SELECT item_id AS query_id, trim(lower(CASE WHEN item_id % 100 = 0 THEN split_part(text, ' ', 3) ELSE substr(text, 1, 2) END)) AS asked, 'u' || (item_id % 7) AS user_id FROM benchmark WHERE item_id % 50 = 0"


@query("search_jds_index", f"SELECT query_id, id, title, company FROM jds j, ({_ASKED}) q WHERE asked <> '' AND deleted_at IS NULL AND (j.user_id = q.user_id OR is_public) AND (contains(lower(title), asked) OR contains(lower(company), asked) OR contains(lower(raw_text), asked) OR contains(lower(position_tag), asked)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY is_public, crawled_at DESC, id) <= 30", ("jds",))
def search_jds_index(spark, d):
    """What a query set of users and words finds among own and public postings, by trigrams; two letters by a scan."""
    word = F.when(F.col("item_id") % 100 == 0, F.split_part("text", F.lit(" "), F.lit(3))).otherwise(F.substring("text", 1, 2))
    asked = S.table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.trim(word).alias("query_text"), F.concat(F.lit("u"), F.col("item_id") % 7).alias("asker"))
    rows, columns = S.live(S.jds(spark, d)), ["title", "company", "raw_text", "position_tag"]
    index = G.build_trigrams(rows.select("id", F.concat_ws("\n", *columns).alias("text")), work_path(spark, "trigrams"))
    found = G.search(index, rows, asked, columns).join(F.broadcast(asked.drop("query_text")), "query_id").where("user_id = asker or is_public")  # the query set
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("is_public", F.desc("crawled_at"), "id"))
    return found.withColumn("rank", first).where("rank <= 30").select("query_id", "id", "title", "company")


_TEXTS = "SELECT item_id AS query_id, lower(split_part(text, ' ', 3)) AS asked, 'u' || (item_id % 7) AS asker FROM benchmark WHERE item_id % 50 = 0"


@query("retrieve_fallback", f"SELECT query_id, id, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS ranked_score FROM jds, ({_TEXTS}) WHERE asked <> '' AND user_id = asker AND contains(lower(raw_text), asked) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 5", ("jds",))
def retrieve_fallback(spark, d):
    """A query set's words, each among its user's postings, without scores."""
    asked = S.table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit(" "), F.lit(3)).alias("query_text"), F.concat(F.lit("u"), F.col("item_id") % 7).alias("asker"))
    rows = S.jds(spark, d).select("id", "user_id", F.lower("raw_text").alias("said"))
    # a row meets the queries of its user alone
    found = rows.join(asked.where("query_text <> ''"), F.col("user_id") == F.col("asker")).where(F.col("said").contains(F.lower("query_text")))
    return R.top(found.select("query_id", "id"), 5, "query_id").select("query_id", "id", F.lit(0.0).alias("similarity"), F.lit(0.0).alias("ranked_score"))


@query("retrieve_two_pass", f"SELECT query_id, branch, id FROM (SELECT *, min(branch) OVER (PARTITION BY query_id) AS first FROM (SELECT query_id, 1 AS branch, id, similarity FROM ({_SIM}) WHERE chunk_type = 'requirement' AND similarity >= 0.3 UNION ALL SELECT query_id, 2, id, similarity FROM ({_SIM}))) WHERE branch = first QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5", ("chunks",))
def retrieve_two_pass(spark, d):
    """Requirements first; all types where no requirement is near enough. One pass gives the best of both kinds."""
    near = similar(spark, d, 5, by="required")
    both = near.where("required and similarity >= 0.3").withColumn("branch", F.lit(1)).unionByName(near.withColumn("branch", F.lit(2)))
    first = both.withColumn("first", F.min("branch").over(Window.partitionBy("query_id"))).where("branch = first")
    return R.top(first, 5).select("query_id", "branch", "id")


_TOP20 = f"SELECT * FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 20"


_TOP10_ALL = f"SELECT * FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10"
_TOP10 = f"SELECT * FROM (SELECT s.*, t.chunk_text FROM ({_SIM}) s LEFT JOIN chunk_texts t ON t.id = s.id) WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10"
_OF = "coalesce(list(substr(chunk_text, 1, 40) ORDER BY similarity DESC, id) FILTER (WHERE chunk_text IS NOT NULL AND {}), [])"


@query("retrieve_to_structured", f"SELECT query_id, {_OF.format("chunk_type = 'responsibility'")} AS responsibilities, {_OF.format("chunk_type = 'requirement'")} AS requirements, {_OF.format("chunk_type NOT IN ('responsibility', 'requirement')")} AS other, list_sort(list_distinct(list(jd_id))) AS jds FROM ({_TOP10}) GROUP BY query_id", ("chunks", "chunk_texts"))
def retrieve_to_structured(spark, d):
    """Texts of the ten best hits of 0.4 and more, by type, and the postings that they are from."""
    near = similar(spark, d, 10).where("similarity >= 0.4").join(S.chunk_texts(spark, d), "id", "left")
    hits = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "id", "chunk_type", F.substring("chunk_text", 1, 40).alias("text"))))
    lists = near.groupBy("query_id").agg(hits.alias("h"), F.sort_array(F.collect_set("jd_id")).alias("jds"))  # ten hits each
    of = lambda test: F.filter(F.transform(F.filter("h", test), lambda x: x["text"]), lambda x: x.isNotNull())
    return lists.select("query_id", of(lambda x: x["chunk_type"] == "responsibility").alias("responsibilities"), of(lambda x: x["chunk_type"] == "requirement").alias("requirements"), of(lambda x: ~x["chunk_type"].isin("responsibility", "requirement")).alias("other"), "jds")


_TOP20T = f"SELECT *, chunk_type IN ('requirement', 'responsibility') AS useful FROM (SELECT s.*, t.chunk_text FROM ({_SIM}) s LEFT JOIN chunk_texts t ON t.id = s.id WHERE s.query_id % 100 = 0 OR s.chunk_type NOT IN ('requirement', 'responsibility')) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 20"


@query("skeleton_context", f"SELECT query_id, string_agg(substr(coalesce(chunk_text, ''), 1, 300), chr(10) || '---' || chr(10) ORDER BY similarity DESC, id) AS context FROM (SELECT * FROM (SELECT *, bool_or(useful) OVER (PARTITION BY query_id) AS any_useful FROM ({_TOP20T})) WHERE useful OR NOT any_useful QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10) GROUP BY query_id", ("chunks", "chunk_texts"))
def skeleton_context(spark, d):
    """Texts of the ten best useful hits of twenty; of all hits where none is useful."""
    near = similar(spark, d, 20, by="useful")
    hits = R.top(near.where((F.col("query_id") % 100 == 0) | ~F.col("useful")), 20).drop("rank")
    whole = hits.withColumn("any_useful", F.bool_or("useful").over(Window.partitionBy("query_id"))).where("useful or not any_useful")
    first = R.top(whole, 10).join(S.chunk_texts(spark, d), "id", "left")
    listed = F.sort_array(F.collect_list(F.struct("rank", F.substring(F.coalesce("chunk_text", F.lit("")), 1, 300).alias("said"))))
    return first.groupBy("query_id").agg(F.array_join(listed["said"], "\n---\n").alias("context"))


# -- joins of chunks, postings and lists ------------------------------------------------------------


@query("left_join_chunks_jds", "SELECT c.id, c.jd_id, j.title, j.position_tag FROM chunks c LEFT JOIN jds j ON j.id = c.jd_id WHERE j.position_tag = 'p2'", ("chunks", "jds"))
def left_join_chunks_jds(spark, d):
    """The filter on the optional side makes the join an inner one; Catalyst sees that."""
    return tagged(spark, d, S.chunks(spark, d)).where("position_tag = 'p2'").select("id", "jd_id", "title", "position_tag")


@query("in_list_join", "SELECT id, chunk_type FROM chunks WHERE jd_id IN (SELECT item_id FROM benchmark)", ("chunks",))
def in_list_join(spark, d):
    keys = S.table(spark, d, "benchmark").selectExpr("item_id AS jd_id").distinct()
    return S.chunks(spark, d).join(keys, "jd_id", "left_semi").select("id", "chunk_type")


@query("dict_lookup_join", "SELECT m.id, m.jd_id, coalesce(j.source, '') AS source FROM matches m LEFT JOIN jds j ON j.id = m.jd_id", ("matches", "jds"))
def dict_lookup_join(spark, d):
    index = S.jds(spark, d).select(F.col("id").alias("jd_id"), "source")
    return S.matches(spark, d).join(index, "jd_id", "left").select("id", "jd_id", F.coalesce("source", F.lit("")).alias("source"))


@query("history_lookup_default", "SELECT user_id, count(*) AS n, round(avg(score), 1) AS mean, count(*) FILTER (WHERE score >= 85) AS high, count(*) FILTER (WHERE score >= 70 AND score < 85) AS medium FROM (SELECT a.user_id, coalesce(h.score + 50, 75) AS score FROM (SELECT o_custkey AS user_id, o_orderkey * 3 % 2000 AS jd_id FROM orders) a LEFT JOIN (SELECT jd_id, score FROM matches QUALIFY row_number() OVER (PARTITION BY jd_id ORDER BY id) = 1) h ON h.jd_id = a.jd_id) GROUP BY user_id", ("matches",))
def history_lookup_default(spark, d):
    """Scores of applications from the first match of their posting, 75 where there is none. Sums are of decimals,
    as those of doubles depend on the order in which rows come; tenths are rounded as SQL does it, as whole numbers."""
    first = store.first_by(S.matches(spark, d), ["jd_id"], F.asc("id")).select("jd_id", "score")
    applied = S.table(spark, d, "orders").selectExpr("o_custkey AS user_id", "o_orderkey * 3 % 2000 AS jd_id")
    score = F.coalesce(F.col("score") + 50, F.lit(75.0))
    mean = F.sum(score.cast("decimal(28,10)")).cast("double") / F.count("*")
    return applied.join(first, "jd_id", "left").groupBy("user_id").agg(F.count("*").alias("n"), (F.round(mean * 10) / 10).alias("mean"), F.count_if(score >= 85).alias("high"), F.count_if((score >= 70) & (score < 85)).alias("medium"))


@query("merge_records_join", "SELECT coalesce(a.query_id, b.query_id, c.query_id) AS query_id, a.n, b.best, c.mocks FROM (SELECT query_id, count(*) AS n FROM ranked WHERE rank > 2 GROUP BY ALL) a FULL JOIN (SELECT query_id, max(score) AS best FROM ranked WHERE source = 'O' GROUP BY ALL) b ON a.query_id = b.query_id FULL JOIN (SELECT query_id, count(*) AS mocks FROM ranked WHERE is_mock GROUP BY ALL) c ON coalesce(a.query_id, b.query_id) = c.query_id", ("ranked",))
def merge_records_join(spark, d):
    r = S.ranked(spark, d)
    a = r.where("rank > 2").groupBy("query_id").agg(F.count("*").alias("n"))
    b = r.where("source = 'O'").groupBy("query_id").agg(F.max("score").alias("best"))
    c = r.where("is_mock").groupBy("query_id").agg(F.count("*").alias("mocks"))
    return a.join(b, "query_id", "full_outer").join(c, "query_id", "full_outer").select("query_id", "n", "best", "mocks")


@query("self_retrieval_semi", f"SELECT query_id, bool_or(jd_id = query_id % 100) AS hit FROM ({_TOP20}) GROUP BY query_id", ("chunks",))
def self_retrieval_semi(spark, d):
    return similar(spark, d, 20).groupBy("query_id").agg(F.bool_or(F.col("jd_id") == F.col("query_id") % 100).alias("hit"))


@query("zip_join", "SELECT query_id, rank, score, score2 FROM ranked", ("ranked",))
def zip_join(spark, d):
    """Two lists in parallel, joined by position."""
    lists = S.ranked(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "score2"))).alias("x"))
    zipped = lists.select("query_id", F.posexplode(F.arrays_zip(F.col("x.score").alias("score"), F.col("x.score2").alias("score2"))).alias("at", "z"))
    return zipped.select("query_id", (F.col("at") + 1).alias("rank"), F.col("z.score").alias("score"), F.col("z.score2").alias("score2"))


# a rounded negative number may be -0.0 in SQL; 0 makes it 0.0
@query("cross_join_score", f"SELECT query_id, id, round(similarity, 4) + 0 AS similarity FROM ({_SIM})", ("chunks",))
def cross_join_score(spark, d):
    return V.similar(S.chunks(spark, d).select("id", "embedding"), queries(spark, d), None).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query("set_overlap_at_k", f"WITH a AS (SELECT query_id, id FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10), b AS (SELECT query_id, id FROM ({_SIM}) WHERE chunk_type <> 'full' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10) SELECT a.query_id, count(b.id) / 10.0::DOUBLE AS overlap FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY a.query_id".replace("WITH a AS", ", a AS"), ("chunks",))
def set_overlap_at_k(spark, d):
    """Share of the top ten that two retrieval paths have in common: of all types, and without full ones."""
    near = similar(spark, d, 10, by="full")
    ids = lambda df: R.top(df, 10).groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    both = ids(near).join(ids(near.where("not full")).withColumnRenamed("ids", "other"), "query_id")
    return both.select("query_id", (F.size(F.array_intersect("ids", "other")) / 10.0).alias("overlap"))


_COSINE = "SELECT c.id, q.query_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS similarity FROM chunks c, (" + _Q + ") q"


@query("bench_vec", f"SELECT a.query_id, count(b.id) / 10.0::DOUBLE AS overlap FROM (SELECT query_id, id FROM ({_SIM}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10) a LEFT JOIN (SELECT query_id, id FROM ({_COSINE}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) <= 10) b ON b.query_id = a.query_id AND b.id = a.id GROUP BY a.query_id", ("chunks",))
def bench_vec(spark, d):
    """Overlap of the ten nearest by the scan, and by the index of cells when it is told to be exact."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.collect_set("id").alias(name))
    exact = V.search_index(indexed(spark, d), queries(spark, d), 10, exact=True)
    both = ids(similar(spark, d, 10), "a").join(ids(exact, "b"), "query_id", "left")
    return both.select("query_id", (F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))) / 10.0).alias("overlap"))


# -- evaluation -------------------------------------------------------------------------------------

_PER = """SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN place <= 10 THEN rel / log2(place + 1) ELSE 0 END) AS idcg,
   CAST(sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS BIGINT) AS n_relevant, min(CASE WHEN rel = 1 THEN rank END) AS first_relevant
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS place FROM (SELECT query_id, rank, CAST({score} >= 3 AS INTEGER) AS rel FROM ranked)) GROUP BY query_id"""
_MET = "count(*) AS n_queries, round(coalesce(avg(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END), 0), 4) AS ndcg, round(coalesce(avg(n_relevant / 10), 0), 4) AS recall, round(coalesce(avg(coalesce(1 / first_relevant, 0)), 0), 4) AS mrr, round(coalesce(avg(CAST(n_relevant > 0 AS INTEGER)), 0), 4) AS hit_rate"


def per(spark, d, score="score"):
    return M.per_query(S.ranked(spark, d), F.expr(score))


@query("win_rank_in_query", "SELECT query_id, min(rank) FILTER (WHERE score >= 3) AS first_relevant, min(rank) FILTER (WHERE is_origin) AS origin_rank FROM ranked GROUP BY query_id", ("ranked",))
def win_rank_in_query(spark, d):
    return S.ranked(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("score") >= 3, F.col("rank"))).alias("first_relevant"), F.min(F.when(F.col("is_origin"), F.col("rank"))).alias("origin_rank"))


@query("win_dcg", f"SELECT query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg FROM ({_PER.format(score='score')})", ("ranked",))
def win_dcg(spark, d):
    return per(spark, d).select("query_id", F.round("dcg", 6).alias("dcg"), F.round("idcg", 6).alias("idcg"))


@query("eval_metrics", f"SELECT {_MET} FROM ({_PER.format(score='score')})", ("ranked",))
def eval_metrics(spark, d):
    return M.metrics(per(spark, d))


@query("eval_failures", f"SELECT query_id FROM ({_PER.format(score='score')}) WHERE n_relevant = 0 ORDER BY query_id LIMIT 5", ("ranked",))
def eval_failures(spark, d):
    """Queries without a relevant result, the first five as a sample."""
    return per(spark, d).where("n_relevant = 0").orderBy("query_id").limit(5).select("query_id")


_RHO = """SELECT query_id, count(*) AS n, CASE WHEN sp > 0 THEN (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt(greatest(sp, 1e-12)) ELSE 0 END AS rho FROM (SELECT *,
  (count(*) OVER w * sum(rx * rx) OVER w - (sum(rx) OVER w) * (sum(rx) OVER w)) * (count(*) OVER w * sum(ry * ry) OVER w - (sum(ry) OVER w) * (sum(ry) OVER w)) AS sp
  FROM (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2 AS rx, rank() OVER (PARTITION BY query_id ORDER BY score2) + (count(*) OVER (PARTITION BY query_id, score2) - 1) / 2 AS ry FROM ranked)
  WINDOW w AS (PARTITION BY query_id)) GROUP BY query_id, sp"""


@query("win_spearman_rank", f"SELECT query_id, n, round(rho, 6) AS rho FROM ({_RHO})", ("ranked",))
def win_spearman_rank(spark, d):
    return M.spearman(S.ranked(spark, d), "score", "score2", "query_id").select("query_id", "n", F.round("rho", 6).alias("rho"))


_TWO = f"SELECT a.query_id, CASE WHEN a.idcg = 0 THEN 0 ELSE a.dcg / a.idcg END AS x, CASE WHEN b.idcg = 0 THEN 0 ELSE b.dcg / b.idcg END AS y FROM ({_PER.format(score='score')}) a JOIN ({_PER.format(score='score2')}) b ON a.query_id = b.query_id"


def two_ndcgs(spark, d):
    """query_id, x, y: both judges' NDCG, from one pass with a row for each judge and rank."""
    rows = S.ranked(spark, d).select("query_id", "rank", F.explode(F.create_map(F.lit("x"), F.col("score"), F.lit("y"), F.col("score2"))).alias("judge", "judged"))
    both = M.per_query(rows, F.col("judged"), 10, "judge")
    of = lambda judge: F.max(F.when(F.col("judge") == judge, M.ndcg(F.col("dcg"), F.col("idcg"))))
    return both.groupBy("query_id").agg(of("x").alias("x"), of("y").alias("y"))


@query("eval_spearman", f"SELECT count(*) AS n, round(corr(rx, ry), 4) AS rho, corr(rx, ry) >= 0.8 AS passed, round(avg(abs(x - y)), 4) AS mean_difference FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT query_id, round(x, 9) AS x, round(y, 9) AS y FROM ({_TWO})))", ("ranked",))
def eval_spearman(spark, d):
    """Rank correlation of two judges' NDCG over all queries. Ranks come from counts by value, so no
    window holds all queries: lists of ten with binary relevance have at most 2**10 values of NDCG."""
    both = work_table(two_ndcgs(spark, d), "ndcg").select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))

    def ranks(c):
        values = both.groupBy(c).agg(F.count("*").alias("n"))
        below = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return values.select(c, (F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2).alias(f"r{c}"))

    ranked = both.join(F.broadcast(ranks("x")), "x").join(F.broadcast(ranks("y")), "y")  # 2**10 values at most
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 4).alias("rho"), (F.corr("rx", "ry") >= 0.8).alias("passed"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mean_difference"))


_CASES = {"real": "score", "no_mock": "CASE WHEN is_mock THEN 1 ELSE score END", "no_cross": "CASE WHEN source <> 'O' THEN 1 ELSE score END", "clean": "CASE WHEN is_mock OR source <> 'O' THEN 1 ELSE score END"}


@query("eval_counterfactual", " UNION ALL ".join(f"SELECT '{n}' AS variant, {_MET} FROM ({_PER.format(score=f'({c})')})" for n, c in _CASES.items()), ("ranked",))
def eval_counterfactual(spark, d):
    """Metrics with mock or foreign judgements set to 1; one scan, one row for each variant and rank."""
    cases = F.array(*[F.struct(F.lit(n).alias("variant"), F.expr(c).alias("judged")) for n, c in _CASES.items()])
    rows = S.ranked(spark, d).select("query_id", "rank", F.inline(cases))
    return M.metrics(M.per_query(rows, F.col("judged"), 10, "variant"), 10, "variant")


@query("eval_compare", f"SELECT m.metric, round(m.old, 4) AS old, round(m.new, 4) AS new, round(m.new - m.old, 4) AS delta, CASE WHEN m.old = 0 THEN 0 ELSE round((m.new - m.old) / m.old, 4) END AS relative, CASE WHEN round(m.new - m.old, 4) > 0.005 THEN 'better' WHEN round(m.new - m.old, 4) < -0.005 THEN 'worse' ELSE 'same' END AS verdict FROM (SELECT unnest(['ndcg', 'mrr', 'hit_rate']) AS metric, unnest([a.ndcg, a.mrr, a.hit_rate]) AS old, unnest([b.ndcg, b.mrr, b.hit_rate]) AS new FROM (SELECT {_MET} FROM ({_PER.format(score='score')})) a, (SELECT {_MET} FROM ({_PER.format(score='score2')})) b) m", ("ranked",))
def eval_compare(spark, d):
    old, new = M.metrics(per(spark, d)), M.metrics(per(spark, d, "score2"))
    names = ("ndcg", "mrr", "hit_rate")
    long = lambda df, c: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", c))
    both = long(old, "old").join(long(new, "new"), "metric").withColumn("delta", F.round(F.col("new") - F.col("old"), 4))
    relative = F.when(F.col("old") == 0, 0.0).otherwise(F.round((F.col("new") - F.col("old")) / F.col("old"), 4))
    return both.select("metric", "old", "new", "delta", relative.alias("relative"), F.when(F.col("delta") > 0.005, "better").when(F.col("delta") < -0.005, "worse").otherwise("same").alias("verdict"))


@query("eval_self_retrieval", f"SELECT avg(CAST(hit AS INTEGER)) AS hit_rate, round(min(best), 4) AS least, round(median(best), 4) AS middle, round(avg(best), 4) AS mean, round(max(best), 4) AS most FROM (SELECT query_id, bool_or(jd_id = query_id % 100 AND rank <= 5) AS hit, max(similarity) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM ({_SIM})) GROUP BY query_id)", ("chunks",))
def eval_self_retrieval(spark, d):
    found = R.top(similar(spark, d, 5), 5).groupBy("query_id").agg(F.bool_or(F.col("jd_id") == F.col("query_id") % 100).alias("hit"), F.max("similarity").alias("best"))
    return found.agg(F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.round(F.min("best"), 4).alias("least"), F.round(F.percentile("best", F.lit(0.5)), 4).alias("middle"), F.round(F.avg("best"), 4).alias("mean"), F.round(F.max("best"), 4).alias("most"))


@query("eval_origin_hits", "SELECT count(*) FILTER (WHERE r = 1) AS top1, count(*) FILTER (WHERE r <= 3) AS top3, count(*) FILTER (WHERE r <= 10) AS top10, count(*) AS n FROM (SELECT query_id, min(CASE WHEN is_origin THEN rank END) AS r FROM ranked GROUP BY query_id)", ("ranked",))
def eval_origin_hits(spark, d):
    r = S.ranked(spark, d).groupBy("query_id").agg(F.min(F.when(F.col("is_origin"), F.col("rank"))).alias("r"))
    return r.agg(F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= 3).alias("top3"), F.count_if(F.col("r") <= 10).alias("top10"), F.count("*").alias("n"))


@query("eval_weak_counts", f"SELECT count(*) FILTER (WHERE n_relevant = 0) AS none, count(*) FILTER (WHERE n_relevant BETWEEN 1 AND 2) AS weak FROM ({_PER.format(score='score')})", ("ranked",))
def eval_weak_counts(spark, d):
    return per(spark, d).agg(F.count_if(F.col("n_relevant") == 0).alias("none"), F.count_if(F.col("n_relevant").between(1, 2)).alias("weak"))


_ASKED = "CASE WHEN l_orderkey % 3 > 0 THEN l_linestatus END AS source, CASE l_linenumber % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS form, l_returnflag AS kind"


@query("agg_eval_dims", f"SELECT dimension, coalesce(value, 'cross') AS value, count(*) AS n FROM (SELECT unnest(['source', 'form', 'type']) AS dimension, unnest([source, form, kind]) AS value FROM (SELECT {_ASKED} FROM lineitem)) GROUP BY ALL")
def agg_eval_dims(spark, d):
    """Queries by source (none is 'cross'), by form and by type, from one pass."""
    said = F.expr("map('source', coalesce(source, 'cross'), 'form', form, 'type', kind)")
    return S.table(spark, d, "lineitem").selectExpr(*S.fields(_ASKED)).select(F.explode(said).alias("dimension", "value")).groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query("classify_failure", "SELECT q.query_id, CASE WHEN r.query_id IS NULL THEN 'no_result_record' WHEN n = 0 THEN 'no_recall_at_all' WHEN zh AND o > 0.7 THEN 'cross_language_zh_to_en' WHEN NOT zh AND f > 0.7 THEN 'cross_language_en_to_zh' WHEN zh AND f > 0.7 THEN 'same_language_but_unrelated' ELSE 'mixed' END AS reason FROM (SELECT o_orderkey AS query_id, o_orderkey % 2 = 0 AS zh FROM orders) q LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE query_id % 11 > 0) AS n, avg(CAST(source = 'O' AS INTEGER)) AS o, avg(CAST(source = 'F' AS INTEGER)) AS f FROM ranked GROUP BY query_id) r ON r.query_id = q.query_id", ("ranked",))
def classify_failure(spark, d):
    """Why a query found nothing: no record, no hits, hits of another language, or of the same one."""
    share = lambda s: F.avg((F.col("source") == s).cast("int"))
    asked = S.table(spark, d, "orders").selectExpr("o_orderkey AS query_id", "o_orderkey % 2 = 0 AS zh")
    r = S.ranked(spark, d).groupBy("query_id").agg(F.count_if(F.col("query_id") % 11 > 0).alias("n"), share("O").alias("o"), share("F").alias("f"))
    reason = F.when(F.col("n").isNull(), "no_result_record").when(F.col("n") == 0, "no_recall_at_all").when(F.col("zh") & (F.col("o") > 0.7), "cross_language_zh_to_en").when(~F.col("zh") & (F.col("f") > 0.7), "cross_language_en_to_zh").when(F.col("zh") & (F.col("f") > 0.7), "same_language_but_unrelated").otherwise("mixed")
    return asked.join(r, "query_id", "left").select("query_id", reason.alias("reason"))


@query("topk_drift", f"SELECT query_id, round(abs(x - y), 6) AS drift FROM ({_TWO}) ORDER BY round(abs(x - y), 6) DESC, query_id LIMIT 5", ("ranked",))
def topk_drift(spark, d):
    return two_ndcgs(spark, d).select("query_id", F.round(F.abs(F.col("x") - F.col("y")), 6).alias("drift")).orderBy(F.desc("drift"), "query_id").limit(5)


@query("sample_stratified", f"SELECT query_id, difficulty FROM (SELECT query_id, CASE WHEN n >= 0.8 THEN 'easy' WHEN n <= 0.3 THEN 'hard' ELSE 'boundary' END AS difficulty FROM (SELECT query_id, CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END AS n FROM ({_PER.format(score='score')}))) QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5('42:' || query_id)) <= CASE difficulty WHEN 'easy' THEN 20 ELSE 15 END", ("ranked",))
def sample_stratified(spark, d):
    n = M.ndcg(F.col("dcg"), F.col("idcg"))
    rows = per(spark, d).select("query_id", F.when(n >= 0.8, "easy").when(n <= 0.3, "hard").otherwise("boundary").alias("difficulty"))
    return M.quota(rows, ["difficulty"], F.when(F.col("difficulty") == "easy", 20).otherwise(15), 20, M.seeded("query_id", 42))


@query("win_stratified_quota", "SELECT query_id, rank, source FROM ranked QUALIFY row_number() OVER (PARTITION BY source, rank ORDER BY md5('7:' || query_id)) <= 5", ("ranked",))
def win_stratified_quota(spark, d):
    return M.quota(S.ranked(spark, d).select("query_id", "rank", "source"), ["source", "rank"], F.lit(5), 5, M.seeded("query_id", 7))


@query("sample_fixed_n", "SELECT r.query_id, r.rank, r.candidate FROM ranked r JOIN (SELECT query_id FROM (SELECT DISTINCT query_id FROM ranked) ORDER BY md5('42:' || query_id) LIMIT 30) q ON q.query_id = r.query_id WHERE r.rank <= 5", ("ranked",))
def sample_fixed_n(spark, d):
    """A seeded sample of queries with the first candidates of each."""
    r = S.ranked(spark, d)
    drawn = r.select("query_id").distinct().orderBy(M.seeded("query_id", 42)).limit(30)
    return r.join(F.broadcast(drawn), "query_id", "left_semi").where("rank <= 5").select("query_id", "rank", "candidate")


_POOL = "SELECT p_partkey AS candidate, CASE p_size % 2 WHEN 0 THEN 'O' ELSE 'F' END AS source, md5('pool:' || p_partkey) AS place FROM part"
_PICKED = """, asked AS (SELECT query_id, arg_min(source, rank) AS source, arg_min(candidate, rank) FILTER (WHERE is_origin) AS origin FROM ranked GROUP BY query_id),
  listed AS (SELECT query_id, candidate, min(ord) AS ord FROM (SELECT query_id, origin AS candidate, 0 AS ord FROM asked WHERE origin IS NOT NULL UNION ALL SELECT query_id, candidate, rank FROM ranked WHERE rank <= 10) GROUP BY query_id, candidate),
  counted AS (SELECT a.query_id, a.source, count(l.candidate) AS n FROM asked a LEFT JOIN listed l ON l.query_id = a.query_id GROUP BY ALL),
  pool AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) - 1 AS number, count(*) OVER (PARTITION BY source) AS size FROM ({pool})),
  more AS (SELECT c.query_id, p.candidate, 100 + k AS ord, c.n FROM counted c, (SELECT unnest(range(0, 9)) AS k) ks, pool p WHERE c.n < 5 AND p.source = c.source AND p.number = (CAST('0x' || substr(md5('golden:' || c.query_id), 1, 8) AS BIGINT) + k) % p.size),
  fresh AS (SELECT m.query_id, m.candidate, m.ord FROM (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY m.ord) AS place FROM (SELECT query_id, candidate, min(ord) AS ord, any_value(n) AS n FROM more GROUP BY query_id, candidate) m ANTI JOIN listed l ON l.query_id = m.query_id AND l.candidate = m.candidate) m WHERE m.place <= 5 - m.n)
  SELECT query_id, candidate, CASE WHEN ord = 0 THEN 'origin' ELSE 'recalled' END AS why, ord FROM listed UNION ALL SELECT query_id, candidate, 'distractor', CAST(ord AS INTEGER) FROM fresh""".replace("{pool}", _POOL)


@query("golden_candidates", _PICKED, ("ranked",))
def golden_candidates(spark, d):
    """The origin first, then up to ten recalled ones, then distractors of the query's source up to five in all.

    Distractors are neighbours in a hashed order of their source, from a hashed place of the query on,
    so that queries and pool are joined by number.
    """
    r = S.ranked(spark, d)
    asked = r.groupBy("query_id").agg(F.min_by("source", "rank").alias("source"), F.min_by(F.when(F.col("is_origin"), F.col("candidate")), F.when(F.col("is_origin"), F.col("rank"))).alias("origin"))
    listed = asked.where("origin is not null").selectExpr("query_id", "origin AS candidate", "0 AS ord").unionByName(r.where("rank <= 10").selectExpr("query_id", "candidate", "rank AS ord"))
    listed = listed.groupBy("query_id", "candidate").agg(F.min("ord").alias("ord"))
    counted = asked.select("query_id", "source").join(listed.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pool = S.table(spark, d, "part").select(F.col("p_partkey").alias("candidate"), F.when(F.col("p_size") % 2 == 0, "O").otherwise("F").alias("source"), F.md5(F.concat(F.lit("pool:"), "p_partkey")).alias("place"))
    pool = M.numbered(pool, "source", F.substring("place", 1, 2), "place").select("source", "candidate", (F.col("number") - 1).alias("number"))
    sizes = pool.groupBy("source").agg(F.count("*").alias("size"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit("golden:"), "query_id")), 1, 8), 16, 10).cast("bigint")
    wanted = counted.where("n < 5").join(F.broadcast(sizes), "source").select("query_id", "source", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: (start + k) % F.col("size"))).alias("k", "number"))  # a row for each source
    more = wanted.join(pool, ["source", "number"]).groupBy("query_id", "candidate").agg(F.min(F.col("k") + 100).alias("ord"), F.first("n").alias("n")).join(listed.select("query_id", "candidate"), ["query_id", "candidate"], "left_anti")
    fresh = more.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where("place <= 5 - n")
    return listed.select("query_id", "candidate", F.when(F.col("ord") == 0, "origin").otherwise("recalled").alias("why"), "ord").unionByName(fresh.select("query_id", "candidate", F.lit("distractor").alias("why"), "ord"))


_PY_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query("mock_judge", f"SELECT query_id, id, CASE WHEN n >= greatest(2, 0.4 * w) THEN 4 WHEN n >= 1 THEN 3 ELSE 2 END AS score FROM (SELECT query_id, id, len(words) AS w, len(list_filter(words, lambda x: length(x) > 1 AND contains(said, x))) AS n FROM (SELECT s.query_id, s.id, {_PY_WORDS.format("q.title || ' ' || coalesce(q.company, '')")} AS words, lower(coalesce(j.title, '') || ' ' || coalesce(t.chunk_text, '')) AS said FROM ({_TOP10_ALL}) s JOIN jds q ON q.id = s.query_id LEFT JOIN jds j ON j.id = s.jd_id LEFT JOIN chunk_texts t ON t.id = s.id))", ("chunks", "jds", "chunk_texts"))
def mock_judge(spark, d):
    """Overlap of a query's words with the title and text of each of its ten retrieved candidates."""
    near = work_table(similar(spark, d, 10).select("query_id", "id", "jd_id"), "judged")
    said, titles = S.chunk_texts(spark, d), S.jds(spark, d).select("id", "title", "company")
    asked = titles.select(F.col("id").alias("query_id"), F.concat("title", F.lit(" "), F.coalesce("company", F.lit(""))).alias("query"))
    # texts of candidates alone: ids first, then their rows
    rows = near.join(asked, "query_id").join(titles.select(F.col("id").alias("jd_id"), "title"), "jd_id", "left").join(said, "id", "left")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("chunk_text", F.lit("")))
    return rows.select("query_id", "id", M.overlap_verdict(F.col("query"), text).alias("score"))
