"""Rules over sources and verdicts on literals."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import measure, mutate
from lodestone.sources import replies


def test_merge_sources(spark):
    jobs = spark.createDataFrame([(1, "http://a?x=1", "", "old", 5), (2, "http://a#t", "B", "old", 6), (3, None, "C", "old", 7), (4, "?q", "D", None, 8)], "id int, url string, title string, source string, low int")
    more = spark.createDataFrame([(1, "http://a", "E", "9K"), (2, "http://b", None, "8K")], "id int, url string, title string, pay string")
    got = {(r.url, r.id, r.title, r.source, r.low, r.pay) for r in mutate.merge_sources({"crawler": jobs, "jd_crawler": more}, T.strip_url).collect()}
    assert got == {("http://a", 1, "Unknown", "crawler", 5, None), ("http://b", 2, "Unknown", "jd_crawler", None, "8K")}
    assert mutate.merge_sources({"crawler": jobs.limit(0), "jd_crawler": more.limit(0)}, T.strip_url).count() == 0


def test_overlap_verdict(spark):
    rows = [("Senior  Java Developer", "java DEVELOPER wanted"), ("a b c", "a b c"), ("Java", "java"), ("", "x"), ("java go rust c1 c2 c3", "java go"), (None, "x")]
    got = [r.s for r in spark.createDataFrame(rows, "q string, t string").select(measure.overlap_verdict(F.col("q"), F.col("t")).alias("s")).collect()]
    # two of three; letters; one word; none; two of six; a null query has no words
    assert got == [4, 2, 3, 2, 3, 2]


def test_description_at_the_third_site(spark):
    long = "duty " * 12
    rows = [
        f'<div class="description">x {long}</div><div id="jobdesc">{long}</div>', '<div id="jobdesc">short</div><p>one <b>two</b></p><p> </p><p>three</p>',
        f'<div class="jobsection">{long}</div>', f'<span itemprop="description">{long}</span>', "<i>nothing</i>", None, "<p>" + "x" * 12_000 + "</p>",
    ]
    got = [r.t for r in spark.createDataFrame([(h,) for h in rows], "h string").select(replies.indeed_description(F.col("h")).alias("t")).collect()]
    assert got == [long.strip(), "onetwo\nthree", None, long.strip(), None, None, "x" * 10_000]
