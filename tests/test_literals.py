"""Hand-computed cases on literal frames: CJK, malformed input, null keys, bounds."""

import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.functions import blocks as B
from lodestone.functions import postings as P2
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import measure as M
from lodestone.operators import mutate, store
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as V
from lodestone.operators import scoring as P
from lodestone.operators import taxonomy as X
from lodestone.plans import QUERIES
from lodestone.sources import files, frames
from lodestone.streaming import logs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def values(spark, f, inputs):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, t string").orderBy("k").select(f(F.col("t")).alias("x")).collect()]


def test_stars(spark):
    rows = spark.createDataFrame([(None,), (0.7,), (0.69,), (0.5,), (0.49,), (0.3,), (0.29,)], "q double")
    assert [r.x for r in rows.select(T.stars(F.col("q")).alias("x")).collect()] == ["unrated", "4", "3", "3", "2", "2", "1"]


def test_languages(spark):
    texts = ["短", "这是一个关于产品经理岗位的完整中文描述文本内容", "This is a plain English sentence of some length.", "English with 一些中文字符 inside it ok", None]
    assert values(spark, T.detect_language, texts) == ["mixed", "zh", "en", "mixed", "mixed"]
    assert values(spark, T.is_zh, texts) == [True, True, False, False, False]
    assert values(spark, T.tokens, ["Go 语言 v2"]) == [["go", "语", "言", "v2"]]
    assert values(spark, T.estimate_tokens, ["你好", "abcd", "&&", "", None]) == [3, 1, 1, 0, 0]


def test_salaries(spark):
    assert [tuple(x) for x in values(spark, T.salary_k, ["10-20K·14薪", "20K以上", "30K以下", "15k", "面议"])] == [(10, 20), (20, None), (None, 30), (15, 15), (None, None)]
    assert [tuple(x) for x in values(spark, T.salary_range, ["30K-50K", "40", "none"])] == [(30, 50), (40, 40), (None, None)]
    assert [tuple(x) for x in values(spark, T.salary_thousands, ["20,000 - 30,000", "25K - 35K", "", "18,500"])] == [(20, 30), (25, 35), (None, None), (18, 18)]
    assert values(spark, T.days_old, ["Posted 3d ago", "Posted 30d+ ago", "Posted 2w ago", "Posted yesterday", "Posted today", "12d ago", "long ago"]) == [3, 30, 14, 1, 0, 12, None]


def test_cleaning(spark):
    assert values(spark, T.clean_text, ["a\n \n\nb  c\t d 第 3 页 Page 4\x00\r\nx "]) == ["a\n\nb c d  \nx"]
    assert values(spark, T.strip_thinking, ["<think>a\nb</think> hi", "```reasoning\nx\n``` {\"a\": 1}", "```json\n{}\n```", None]) == ["hi", '{"a": 1}', "```json\n{}\n```", ""]
    assert values(spark, T.emails, ["a.b@c.org, x@y"]) == [["a.b@c.org"]]
    assert values(spark, T.phones, ["13912345678 010-12345678 13912345678"]) == [["010-12345678", "13912345678"]]
    assert values(spark, lambda t: T.json_list(t), ['["a"]', "oops", None]) == [["a"], [], []]
    assert values(spark, T.normalize_url, ["https://a.b/job/12?x=1", "https://a.b/c?x#y"]) == ["https://a.b/job/12", "https://a.b/c"]
    assert values(spark, T.loose_json, ['x ```json\n{"a": 1}\n``` y', 'so {"b": 2} then', "none"]) == ['{"a": 1}', '{"b": 2}', "none"]


def test_packing_of_sentences(spark):
    assert values(spark, lambda t: T.cap_length(t, 10), ["short", "One two. Three. Four five six seven.", "Aa. Bb. Cc. Dd."]) == [["short"], ["One two.", "Three.", "Four five six seven."], ["Aa. Bb. Cc.", "Dd."]]
    assert values(spark, lambda t: T.split_long_text(t, 6), ["abc\n\ndef\n\nghi"]) == [["abc\n\n", "def\n\n", "ghi"]]


def test_garbage(spark):
    rows = spark.createDataFrame([("crawler", "登录", "c", "请先登录"), ("manual", "登录", "c", "请先登录"), ("crawler", "Engineer", "c", "captcha " + "x" * 400), (None, None, None, None)], "source string, title string, company string, raw_text string")
    assert [r.x for r in rows.select(T.is_garbage("source", "title", "company", "raw_text", F.lit("p")).alias("x")).collect()] == [True, False, False, False]


def test_chunker(spark):
    text = "We build things for people.\n\nResponsibilities:\n- Write code that works\n- Review the code of others\n\nRequirements\n1. Five years of practice\nGood English, written\nand spoken.\nNice to have:\n• Rust or something like it\n• ok\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "tiny"), (5, "x" * 900)], "id int, raw_text string")
    got = [(r.id, r.chunk_index, r.chunk_type, r.heading_path, r.chunk_text) for r in C.chunk_documents(docs).orderBy("id", "chunk_index").collect()]
    assert got == [
        (1, 0, "overview", [], "We build things for people."),
        (1, 1, "responsibility", ["Responsibilities:"], "Write code that works"),
        (1, 2, "responsibility", ["Responsibilities:"], "Review the code of others"),
        (1, 3, "requirement", ["Requirements"], "Five years of practice"),
        (1, 4, "requirement", ["Requirements"], "Good English, written\nand spoken."),
        (1, 5, "nice_to_have", ["Nice to have:"], "Rust or something like it"),
        (4, 0, "overview", [], "tiny"),
        (5, 0, "overview", [], "x" * 900),
    ]


def test_taxonomy(spark):
    tax = X.flatten(spark, {"互联网": {"产品": ["产品经理", "高级产品经理"]}, "IT": {"dev": ["data engineer", "engineer"]}})
    texts = spark.createDataFrame([(1, "招聘高级产品经理一名"), (2, "engineer data wanted"), (3, "nothing here"), (4, None)], "id int, text string")
    got = {r.id: (r.layer, r.position) for r in X.classify(texts, tax, "id").collect()}
    assert got == {1: (1, "高级产品经理"), 2: (1, "engineer"), 3: (None, None), 4: (None, None)}
    two = spark.createDataFrame([(1, "data-engineer"), (2, "data lake")], "id int, text string")
    assert {r.id: r.position for r in X.by_tfidf(two, tax, "id", 0.6).collect()} == {1: "data engineer", 2: "data engineer"}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "u"), (2, None, "u")], "id int, url string, user string")
    new = spark.createDataFrame([(3, "a", "u"), (4, "b", "u"), (5, "b", "u"), (6, None, "u")], "id int, url string, user string")
    assert sorted(r.id for r in mutate.insert_ignore(old, new, ["url", "user"], F.asc("id")).collect()) == [1, 2, 4, 6]
    rows = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5)], "id int, q double, stamp int")
    tries = spark.createDataFrame([(1, 9.0, None), (2, 9.0, 4)], "id int, q double, expected int")
    assert {r.id: (r.q, r.changed) for r in mutate.compare_and_set(rows, tries, "id", "stamp", ["q"]).collect()} == {1: (9.0, True), 2: (2.0, False)}
    merged = mutate.upsert(rows, spark.createDataFrame([(2, None, None), (3, 7.0, 1)], "id int, q double, stamp int"), "id", keep=["q"])
    assert {r.id: (r.q, r.stamp) for r in merged.collect()} == {1: (1.0, None), 2: (2.0, None), 3: (7.0, 1)}
    logs = spark.createDataFrame([(1, datetime(2024, 1, 1, 12)), (2, datetime(2024, 1, 1, 11)), (3, None)], "id int, at timestamp_ntz")
    assert sorted(r.id for r in mutate.older_than(logs, "at", 30, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).collect()) == [1, 3]


def test_last_write_wins(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, q double")
    new = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (3, 7.0, 2), (3, 8.0, 1)], "id int, q double, at int")
    both = lambda df: sorted((r.id, r.q) for r in df.collect())
    assert both(mutate.upsert(old, new, "id", (), F.col("at"))) == [(1, 6.0), (2, 2.0), (3, 7.0)]
    assert both(mutate.update(old, new, "id", ["q"], F.col("at"))) == [(1, 6.0), (2, 2.0)]
    assert both(mutate.insert_replace(old, new, "id", {}, F.col("at"))) == [(1, 6.0), (2, 2.0), (3, 7.0)]
    assert len(mutate.upsert(old, new, "id").collect()) == 3
    keyed = spark.createDataFrame([(1, "a"), (2, None)], "id int, url string")
    more = spark.createDataFrame([(3, "a"), (4, "b"), (5, "b"), (6, None)], "id int, url string")
    assert sorted((r.id, r.stored_id) for r in mutate.surviving_ids(keyed, more, ["url"], F.asc("id")).collect()) == [(3, 1), (4, 4), (5, 4), (6, 6)]


def test_cache_with_null_function(spark):
    rows = spark.createDataFrame([(1, "p", "i", None, 1, 9), (2, "p", "i", None, 3, 9), (3, "p", "i", "f", 2, 9), (4, "p", "i", "g", 5, 9), (5, "p", "i", "f", 9, 4)], "id int, position string, industry string, function string, updated_at int, expires_at int")
    assert store.cached(rows, "p", "i", "f", F.lit(5)).first().id == 3
    assert store.cached(rows, "p", "i", None, F.lit(5)).first().id == 2


def test_metrics(spark):
    def met(lists):
        rows = [(q, k + 1, s) for q, scores in lists.items() for k, s in enumerate(scores)]
        return M.metrics(M.per_query(spark.createDataFrame(rows, "query_id int, rank int, score int"), F.col("score"))).first()

    assert (met({1: [5, 4], 2: [3, 3]}).ndcg, met({1: [1, 1]}).ndcg, met({1: [1, 4]}).mrr, met({1: [1, 4]}).hit_rate, met({1: [1, 4]}).recall) == (1.0, 0.0, 0.5, 1.0, 0.1)
    pairs = [("same", x, x) for x in range(5)] + [("reversed", x, -x) for x in range(5)] + [("constant", x, 1) for x in range(5)]
    rho = {r.by: round(r.rho, 9) for r in M.spearman(spark.createDataFrame(pairs, "by string, x int, y int"), "x", "y", "by").collect()}
    assert rho == {"same": 1.0, "reversed": -1.0, "constant": 0.0}


def test_retrieval_contract(spark):
    assert (R.candidates_wanted(4, True), R.candidates_wanted(4, False)) == (50, 12)
    rows = spark.createDataFrame([(0, 1, "nice_to_have", 0.7), (0, 2, "overview", 0.7), (0, 3, "requirement", 0.7), (0, 4, "full", 0.3)], "query_id int, id int, chunk_type string, similarity double")
    assert [r.id for r in R.weighted(rows, 5, 0.5).orderBy("rank").collect()] == [3, 2, 1]
    assert sorted(r.id for r in R.weighted(rows, 5, 0.9, rerank=F.lit(0.5)).collect()) == [1, 2, 3, 4]


def test_streams_order_events_by_time(spark, tmp_path):
    """Two files whose events interleave, and a user with more rows than an Arrow batch holds."""
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(milliseconds=140 * k + rng.randrange(90)), 1 if k % 3 else k % 7, "error" if rng.random() < 0.15 else "view", 0.0, "") for k in range(18_000)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for name, part in (("a", rows[1::2]), ("b", rows[::2])):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.parquet(str(tmp_path / name))
    got = {r.user_id: round(r.delay, 6) for r in logs.adaptive_delay(spark, f"{tmp_path}/*/*.parquet").collect()}
    hit = sorted(r.event_id for r in logs.blocked(spark, f"{tmp_path}/*/*.parquet", 1).collect())
    delay, last, until, want = {}, {}, {}, []
    for k, ts, user, kind, *_ in rows:
        if ts < until.get(user, start):
            want.append(k)
        bad = kind == "error"
        if bad:
            until[user] = ts + timedelta(minutes=1)
        last[user] = [*last.get(user, []), not bad][-10:]
        share, x = sum(last[user]) / len(last[user]), delay.get(user, 2.0)
        delay[user] = min(60.0, x * 1.5) if share < 0.8 else max(1.0, x * 0.9) if share > 0.95 else x
    assert sum(r[2] == 1 for r in rows) > 12_000
    assert got == {u: round(x, 6) for u, x in delay.items()} and hit == want


def test_similarities_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0], "a" if k % 2 else "b") for k in range(40)] + [(40, [0.0, 0.0, 0.0], "a"), (41, [1.0], "a"), (42, None, "b")], "id bigint, embedding array<float>, kind string")
    asked = spark.createDataFrame([(k, [1.0, float(k), 2.0]) for k in range(7)] + [(7, [0.0, 0.0, 0.0])], "query_id bigint, vector array<float>")

    def cosine(a, b):
        n = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        return sum(x * y for x, y in zip(a, b, strict=True)) / (n(a) * n(b))

    data = [(r.id, list(r.embedding), r.kind) for r in rows.collect() if r.embedding is not None and len(r.embedding) == 3]
    want = {}
    for q in asked.collect():
        for kind in ("a", "b"):
            best = sorted((-round(cosine(v, q.vector), 12), i) for i, v, k in data if k == kind)[:3]
            want |= {(q.query_id, i): -s for s, i in best}
    for block in (4096, 3):  # one block, and several
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        got = {(r.query_id, r.id): round(r.similarity, 12) for r in R.similar(rows, asked, 3, by="kind").collect()}
        assert got == want
    assert R.similar(rows, asked, None).count() == 8 * len(data)
    assert R.similar(rows, asked.limit(0), 3).count() == R.similar(rows.limit(0), asked, 3).count() == 0


def test_retrieval_with_filters_and_fallback(spark):
    rows = spark.createDataFrame([(k, k, "requirement" if k % 2 else "overview", f"u{k % 2}", "p", "i" if k > 4 else "j", f"text {k} alpha" if k != 3 else "beta alpha", [1.0, float(k)]) for k in range(8)], "id bigint, chunk_index int, chunk_type string, user_id string, position_tag string, industry_tag string, chunk_text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "text alpha", [1.0, 1.0]), (2, "BETA", None)], "query_id bigint, query_text string, vector array<float>")
    got = [(r.query_id, r.id, r.ranked_score) for r in R.retrieve(rows, asked, 2, 0.5, chunk_type="requirement", user_id="u1", position="p", industry="i").collect()]
    # similarity by weights of type and industry; the text search for the query without a vector
    soft = {k: (1 + k) / math.sqrt(2 * (1 + k * k)) * 1.3 * (1.2 if k > 4 else 1) for k in (1, 3, 5, 7)}
    assert sorted(g[1:] for g in got if g[0] == 1) == sorted(sorted(((k, round(x, 4)) for k, x in soft.items()), key=lambda x: -x[1])[:2])
    assert [g for g in got if g[0] == 2] == [(2, 3, 0.0)]
    scored = R.retrieve(rows, asked, 2, 0.99, chunk_type="requirement", score=R.scorer(R.shared_words)).where("query_id = 1").collect()
    assert len(scored) == 2 and {r.id for r in scored} <= {1, 5, 7}  # the threshold isn't used
    assert R.retrieve(rows, asked, 2, position="other").count() == 0


def test_quality(spark):
    now, day = F.lit("2024-01-31").cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz")
    fresh = P.freshness(day, now)
    assert one(spark, P.authority(F.lit("jobsdb_batch"), F.lit(None).cast("timestamp"))) == 0.9
    assert one(spark, P.authority(F.lit("manual"), day)) == 0.0
    assert one(spark, P.freshness(F.lit(None).cast("timestamp_ntz"), now)) == 0.5
    assert one(spark, P.richness(F.lit("x" * 2000))) == 0.9
    full = P.composite(P.completeness(F.lit(True), F.lit(True), F.lit(5), F.lit("i")), F.lit(0.9), fresh, F.lit(0.9), F.lit(False))
    assert one(spark, full) >= 0.85
    assert one(spark, P.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True))) == 0.2


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.5]), (2, None)], "id int, v array<float>")
    back = {r.id: r.x for r in rows.select("id", files.decode_vectors(files.encode_vectors("v")).alias("x")).collect()}
    assert back == {1: [1.0, 2.5], 2: None}
    embed = files.embedder(lambda: files.hashed_vectors)
    v = spark.createDataFrame([("a",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-5 for r in v)


def test_documents_by_suffix(spark, tmp_path):
    for name, data in (("a.txt", "x"), ("b.MD", "y"), ("c.pdf", "z"), ("d.bin", "w")):
        (tmp_path / name).write_text(data)
    got = {r.file_name: r.text for r in files.read_documents(spark, str(tmp_path), {"pdf": lambda c: F.concat(F.lit("pdf "), F.decode(c, "UTF-8"))}).collect()}
    assert got == {"a.txt": "x", "b.MD": "y", "c.pdf": "pdf z", "d.bin": None}


def test_progress_report(spark, tmp_path):
    summary = spark.createDataFrame([(3, "m")], "n int, model string")
    (tmp_path / "old.json").write_text('{"x": [1, {"y": null}], "baseline": {"n": 1}}')
    (tmp_path / "bad.json").write_text("oops")
    for old, want in (("old.json", {"x": [1, {"y": None}], "baseline": {"n": 3, "model": "m"}}), ("bad.json", {"baseline": {"n": 3, "model": "m"}}), (None, {"baseline": {"n": 3, "model": "m"}})):
        path = old and str(tmp_path / old)
        assert json.loads(files.merge_report(spark, path, "baseline", summary).first().report) == want


def test_rules_of_postings(spark):
    text = "招聘\n任职要求：\n- 5年以上Java经验\n- 精通Python，熟悉SQL数据库\n加分项\n- x"
    assert one(spark, P2.skills_by_rule(F.lit(text))) == ["5", "P", "S", "熟悉SQL数据库"]
    assert one(spark, P2.requirements(F.lit(text))) == ["Python", "Java", "SQL", "5年以上Java经验", "精通Python，熟悉SQL数据库"]
    assert one(spark, P2.labelled(F.lit("x" * 60 + "\n\n Engineer "), "title")) == "Engineer"
    assert one(spark, P2.labelled(F.lit("LOCATION: Bern\n"), "location")) == "Bern"
    said = one(spark, P2.duties_and_needs(F.lit("- early\n职责\n1. a\nplain\n要求\n• b\n- ")))
    assert (said.responsibilities, said.requirements) == (["early", "a"], ["b"])
    # the reference's own cases: no entries, an incomplete and a complete one
    job = "struct<company:string,title:string,duration:string,achievements:array<string>>"
    assert one(spark, P2.lacking(F.array().cast(f"array<{job}>"), "experience")) == ["至少 1 段工作经历"]
    assert one(spark, P2.lacking(F.from_json(F.lit('[{"company": "A", "title": " ", "achievements": [""]}, {"company": "A", "title": "T", "duration": "1", "achievements": ["x"]}]'), f"array<{job}>"), "experience")) == ["第 1 段工作经历：职位", "第 1 段工作经历：起止时间", "第 1 段工作经历：至少 1 个成果"]


def test_blocks(spark):
    level = lambda t, size=10, fonts=("x",): one(spark, B.heading(F.lit(t), F.lit(size), F.array(*map(F.lit, fonts))))
    assert [level(t) for t in ("1.2.3.4. a", "1.2.3. a", "1.2. a", "1. a", "（2）a", "IV. a", "a", " ")] == [4, 3, 2, 1, 1, 1, 0, 0]
    assert (level("a", 20), level("a" * 90, 20), level("a", 10, ("arial-bold",)), level("a", 10, ("Bold",))) == (1, 0, 1, 0)
    assert values(spark, B.looks_like_list, ["- a\n- b", "- a", "- a\nb", "1 a\n2 b\nc"]) == [True, False, False, True]
    assert one(spark, B.markdown(F.array(F.array(F.lit("a"), F.lit(" b ")), F.array(F.lit("")), F.array(F.lit("c"))))) == "| a | b |\n| --- | --- |\n| c |  |"
    assert values(spark, lambda t: B.abstract(t, 10), ["short", "one two three", "一二三。四五，六七八九十"]) == ["short", "one two…", "一二三…"]
    assert values(spark, lambda t: T.truncate_sentence(t, 12), ["One. Two! Three four", "abcdefghijklm", "一二三四五。六七八.九十十一"]) == ["One. Two!", "abcdefghijkl…", "一二三四五。"]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": oops\n{"a": 2}\n')
    path = str(tmp_path / "x.jsonl")
    assert sorted(r.a for r in files.read_jsonl(spark, path, "a int", "skip").collect()) == [1, 2]
    assert [(r.a, r._corrupt_record) for r in files.read_jsonl(spark, path, "a int", "report").collect() if r._corrupt_record] == [(None, '{"a": oops')]


def test_closure_of_deep_and_large_trees(spark, monkeypatch):
    def found(rows):
        monkeypatch.setattr(frames, "tree", lambda spark, d: rows)
        return QUERIES["parent_child_closure"](spark, "")

    # a chain of 301, a root alone, a null id, a missing parent with a row under it, and a cycle with two rows under it
    chain = [(k, k - 1 if k else None) for k in range(301)]
    odd = [(400, None), (None, None), (500, 499), (501, 500), (600, 602), (601, 600), (602, 601), (603, 600), (604, 603)]
    got = found(spark.createDataFrame(chain + odd, "id bigint, parent_id bigint")).collect()
    want = [*((k, 0, k) for k in range(301)), (400, 400, 0), (None, None, 0), (500, 500, 0), (501, 500, 1), (600, 600, 0), (601, 601, 0), (602, 602, 0), (603, 600, 1), (604, 600, 2)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    large = found(spark.range(1_200_000).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id - 1 END AS parent_id"))
    assert large.count() == large.where("root = id - id % 5 and depth = id % 5").count() == 1_200_000
    assert found(spark.createDataFrame([], "id bigint, parent_id bigint")).count() == 0
