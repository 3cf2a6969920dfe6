"""Resumes and jobs matched by their skills: a set-containment join instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import discard, passing_table, shuffles_removed, work_path
from .measure import numbered

#: Fixed values of the rule: points by experience (from years, below years), and the score to apply from.
SENIOR, JUNIOR, POINTS, APPLY = 3, 1, 10, 70

#: Points that a resume may have; ranges in which skills held equally often are numbered; words of a bitmap of skills
#: (a power of two).
CLASSES, PARTS, WORDS = (-POINTS, 0, POINTS), 256, 4

#: Pairs of resume and skill for which another pass is made, and the most passes.
PASS_ROWS, PASSES = 2_000_000, 12


def skill_set(skills: Column) -> Column:
    """Distinct skills in lower case, without nulls, sorted."""
    return F.sort_array(F.array_distinct(F.array_compact(F.transform(F.coalesce(skills, F.array().cast("array<string>")), F.lower))))


def points(years: Column) -> Column:
    years = F.coalesce(years, F.lit(0))
    return F.when(years >= SENIOR, POINTS).when(years < JUNIOR, -POINTS).otherwise(0)


def score(shared: Column, wanted: Column, more: Column) -> Column:
    """Whole percent of the wanted skills that are there, and points, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(shared / wanted * 100) + more)).cast("int")


def bitmap(numbers: Column) -> list[Column]:
    """Words in which each number sets a bit, which others may share."""
    def word(k: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(x, WORDS.bit_length() - 1).bitwiseAND(63).cast("int"))
        found = F.aggregate(F.filter(numbers, lambda x: x.bitwiseAND(WORDS - 1) == k), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(bit(x)))
        return F.coalesce(found, F.lit(0).cast("bigint"))  # else a join looks for nulls first, and computes it twice

    return [word(k) for k in range(WORDS)]


def matches(resumes: DataFrame, jobs: DataFrame, least: int = APPLY) -> DataFrame:
    """resume_id, job_id, score, matched, missing of every pair that reaches ``least`` (over 60).

    resumes: id, skills, years; jobs: id, skills. A job without skills is worth 50 and points, so that it
    never reaches that; nor does a resume without skills.

    Skills are numbered, rare ones first. Of a job's skills, rarest first, a resume that shares as many as it must
    shares one of the first ones: all but that many, and one more. Only these are joined with the resumes' skills; a
    pair counts at the rarest skill it shares, once, if the resume has as many skills as needed. What a resume needs
    depends on its points: a job is listed once, with what it needs of each. Names are fetched for pairs that count.
    Hot skills are seldom among the rare; where they are, the join is one whose partitions adaptive execution splits.

    For that join a resume goes along with each of its skills. That is many times the input, so the skills are dealt
    to passes, and the shuffle files of a pass are removed before the next one. Bitmaps of skills bound what a pair
    can share, so that few pairs are compared by their skills.
    """
    if least <= 50 + POINTS:
        raise ValueError("jobs without skills would reach this with any resume")
    spark = resumes.sparkSession
    people = passing_table(resumes.select(F.col("id").alias("resume_id"), skill_set(F.col("skills")).alias("has"), points(F.col("years")).alias("more")).withColumn("row", F.monotonically_increasing_id()), "people")
    held = passing_table(people.select(F.explode("has").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")), "skills")
    skills, rows = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    part = F.col("n") * PARTS + F.pmod(F.xxhash64("skill"), F.lit(PARTS))
    number = passing_table(numbered(held.withColumn("all", F.lit(0)), "all", part, "skill").select("skill", F.col("number").cast("int" if skills < 1 << 31 else "bigint").alias("number")), "skill-numbers")

    own = passing_table(people.select("row", F.explode("has").alias("skill")).join(number, "skill").select("row", "number"), "resume-numbers")
    each = own.repartition("row").groupBy("row").agg(F.sort_array(F.collect_list("number")).alias("has")).join(people.select("row", "resume_id", "more"), "row")
    each = passing_table(each.select("resume_id", "more", "has", *[w.alias(f"has{k}") for k, w in enumerate(bitmap(F.col("has")))]), "resumes")
    discard(people, held, own)

    wanted = passing_table(jobs.select(F.col("id").alias("job_id"), skill_set(F.col("skills")).alias("names")).where("size(names) > 0").withColumn("row", F.monotonically_increasing_id()), "jobs")
    own = passing_table(wanted.select("row", F.posexplode("names").alias("place", "skill")).join(number, "skill", "left").select("row", "place", F.coalesce("number", F.lit(0)).alias("number")), "job-numbers")
    n = F.size("wants")
    of = lambda x: lambda c: score(c, n, F.lit(x)) >= least
    leasts = [f"least{k}" for k in range(len(CLASSES))]
    fewest = [F.array_min(F.filter(F.sequence(F.lit(1), n), of(x))).alias(c) for c, x in zip(leasts, CLASSES, strict=True)]
    # wants: numbers in the order of the names, 0 for a skill that nobody has
    listed = own.repartition("row").groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "number"))), lambda x: x["number"]).alias("wants"))
    listed = listed.select("row", "wants", *fewest).withColumn("first", n - F.least(*leasts) + 1).where("first is not null")
    listed = passing_table(listed.select("row", "wants", *leasts, F.slice(F.sort_array("wants"), 1, F.col("first")).alias("rarest")), "job-lists")
    discard(number, own)

    rare = listed.select("row", "wants", *leasts, F.posexplode("rarest").alias("at", "number")).where("number > 0")
    offered = each.select("*", F.explode("has").alias("number"))
    needs = F.coalesce(*[F.when(F.col("more") == x, F.col(c)) for c, x in zip(leasts, CLASSES, strict=True)])
    bits = lambda one: sum((F.bit_count(one(k)) for k in range(WORDS)), F.lit(0))
    most = bits(lambda k: F.col(f"has{k}").bitwiseAND(F.col(f"wants{k}"))) + F.col("spare")
    shared = F.when(n == 1, F.array("number")).otherwise(F.array_intersect("has", "wants"))  # rarest first
    # most pairs share one skill alone: the cheap tests come first
    counts = (F.col("at") <= n - needs) & (F.size("has") >= needs) & (most >= needs) & (F.size(shared) >= needs) & (shared[0] == F.col("number"))
    places = F.when(F.size("shared") < n, F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.array_contains("shared", F.get("wants", k))))
    path, passes = work_path(spark, "pairs"), min(PASSES, rows // PASS_ROWS + 1)
    for turn in range(passes):
        mine = F.col("number") % passes == turn
        some = rare.where(mine).select("*", *[w.alias(f"wants{k}") for k, w in enumerate(bitmap(F.col("wants")))])
        some = some.withColumn("spare", n - bits(lambda k: F.col(f"wants{k}")))
        pairs = offered.where(mine).join(some, "number").where(counts).select("resume_id", "row", "more", "wants", shared.alias("shared"))
        # places of the names that are there; null if all are
        pairs = pairs.select("resume_id", "row", score(F.size("shared"), n, F.col("more")).alias("score"), places.alias("places"))
        with shuffles_removed(spark):
            pairs.write.mode("append").option("compression", "zstd").parquet(path)
    discard(each, listed)
    found = spark.read.schema(pairs.schema).parquet(path).join(wanted, "row")
    there = lambda yes: F.filter("names", lambda _, k: F.array_contains("places", k) == F.lit(yes))
    all_there = F.col("places").isNull()
    return found.select("resume_id", "job_id", "score", F.when(all_there, F.col("names")).otherwise(there(True)).alias("matched"), F.when(all_there, F.array().cast("array<string>")).otherwise(there(False)).alias("missing"))
