"""Scores of postings, resumes and matches as column expressions over nested rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a source is trusted.
AUTHORITY = {"51job_batch": 0.90, "jobsdb_batch": 0.90, "liepin_batch": 0.70, "smart_collector": 0.80, "crawler": 0.75, "jd_crawler": 0.75, "manual": 0.85, "pdf": 0.85, "url": 0.80}
OTHER_AUTHORITY = 0.70
GARBAGE_MOST = 0.20
#: Layout of one page, in mm, lines and characters.
PAGE_MM, LINE_MM, HEADER_MM, TITLE_MM, ROW_MM, GAP_MM, LINE_CHARS, SKILLS_A_LINE = 265.0, 4.8, 12.0, 5.0, 4.5, 1.5, 30, 8


def filled(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def points(condition: Column, n: float) -> Column:
    return F.when(condition, float(n)).otherwise(0.0)


def completeness(requirements: Column, preferred: Column, n_tags: Column, industry: Column) -> Column:
    """How much of a posting is structured: 0 to 1."""
    tags = F.when(n_tags > 0, 0.20 + F.least(F.lit(0.20), n_tags * 0.04)).otherwise(0.0)
    return F.least(F.lit(1.0), points(requirements, 0.35) + points(preferred, 0.10) + tags + points(filled(industry), 0.20))


def authority(source: Column, deleted: Column) -> Column:
    out = F.lit(OTHER_AUTHORITY)
    for name, value in AUTHORITY.items():
        out = F.when(source == name, value).otherwise(out)
    return F.when(deleted.isNotNull(), 0.0).otherwise(out)


def freshness(crawled_at: Column, now: Column) -> Column:
    """Logistic decay around 90 days; 0.5 where the time is unknown."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(crawled_at.cast("timestamp"))) / 86_400_000_000)
    return F.when(crawled_at.isNull(), 0.5).otherwise(F.round(1 / (1 + F.exp((days - 90) / 30)), 4))


def richness(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < 200, 0.20).when(n < 500, 0.40).when(n < 1500, 0.70).when(n < 3500, 0.90).otherwise(1.0)


def composite(parsed: Column, trusted: Column, fresh: Column, rich: Column, garbage: Column) -> Column:
    """Weighted quality of a posting; sub-scores are rounded before they are weighed."""
    raw = 0.35 * F.round(parsed, 4) + 0.25 * F.round(trusted, 4) + 0.20 * fresh + 0.20 * rich
    return F.when(garbage, F.least(F.lit(GARBAGE_MOST), raw)).otherwise(F.round(raw, 4))


def mean_points(items: Column, score, most: float) -> Column:
    """Points of the items against the most that they could have, in percent; 0 without items."""
    sums = F.aggregate(F.transform(items, score), F.lit(0.0), lambda s, x: s + F.least(x, F.lit(most)))
    return F.when(F.size(items) > 0, sums / (F.size(items) * most) * 100).otherwise(0.0)


def experience_points(e: Column) -> Column:
    return points(filled(e["company"]), 7.5) + points(filled(e["title"]), 7.5) + points(F.coalesce(F.length(e["description"]) >= 30, F.lit(False)), 7.5) + points(F.coalesce(F.size(e["achievements"]) > 0, F.lit(False)), 7.5)


def project_points(p: Column) -> Column:
    return points(filled(p["name"]), 7.5) + points(filled(p["role"]), 7.5) + points(F.coalesce(F.length(p["description"]) >= 20, F.lit(False)), 7.5) + points(F.coalesce(F.size(p["achievements"]) > 0, F.lit(False)), 7.5)


def education_points(e: Column) -> Column:
    years = e["start_year"].isNotNull() & e["end_year"].isNotNull()
    return points(filled(e["school"]), 5) + points(filled(e["degree"]), 4) + points(filled(e["major"]), 3) + points(years, 3)


def information(experience: Column, projects: Column, education: Column, n_achievements: Column, n_skills: Column) -> Column:
    """How much a resume says, 0 to 100."""
    return (
        mean_points(experience, experience_points, 30.0) * 0.35 + mean_points(projects, project_points, 30.0) * 0.25 + mean_points(education, education_points, 15.0) * 0.15
        + F.least(n_achievements * 25.0, F.lit(100.0)) * 0.15 + F.least(n_skills * 20.0, F.lit(100.0)) * 0.10
    )


def mode(score: Column) -> Column:
    return F.when(score >= 70, "A").when(score >= 40, "A+B").otherwise("B")


def body_lines(items: Column) -> Column:
    """Lines of entries with a title, a description and achievements."""
    one = lambda e: 1 + F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(e["description"], F.lit(""))) / LINE_CHARS)) + F.greatest(F.size(e["achievements"]), F.lit(0))
    return F.aggregate(F.transform(items, lambda e: one(e).cast("int")), F.lit(0), lambda s, x: s + x)


def page(n_header: Column, experience: Column, projects: Column, n_education: Column, n_achievements: Column, n_skills: Column) -> Column:
    """Lines by section, total height and overflow of a resume on one page."""
    header = F.greatest(F.lit(1), F.floor((n_header + 1) / 2)).cast("int")
    skills = F.greatest(F.lit(1), F.floor((n_skills + 8) / SKILLS_A_LINE)).cast("int")
    exp, proj = body_lines(experience), body_lines(projects)
    lines = {"education": n_education, "experience": exp, "projects": proj, "skills": skills, "achievements": n_achievements}
    sections = sum((F.when(v > 0, 1).otherwise(0) for v in lines.values()), F.lit(0))
    mm = HEADER_MM + sections * (TITLE_MM + GAP_MM) + (n_education + skills) * ROW_MM + (exp + proj + n_achievements) * LINE_MM
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-v).alias("n"), F.lit(k).alias("name")) for k, v in lines.items()]), lambda s: s["n"] <= -3))
    return F.struct(
        *[v.cast("int").alias(k) for k, v in lines.items()], (header + sum(lines.values(), F.lit(0))).cast("int").alias("total_lines"),
        F.round(mm, 2).alias("total_mm"), (mm > PAGE_MM).alias("overflow"), F.when(mm > PAGE_MM, F.transform(ranked, lambda s: s["name"])).otherwise(F.array().cast("array<string>")).alias("longest"),
    )


def suggestions(gpas: Column, durations: Column, skills: Column, longest: Column) -> Column:
    """What to leave out of a resume that exceeds a page: a low GPA, short stays, repeated skills, the
    longest sections; at least one."""
    texts = "array<string>"
    low = F.get(F.filter(gpas, lambda g: g < 3.0), 0)
    months = lambda m: F.regexp_extract(m, r"(\d+)\s*月", 1).try_cast("int")
    short = F.transform(F.filter(F.coalesce(durations, F.array().cast(texts)), lambda m: F.coalesce(months(m) < 3, F.lit(False))), lambda m: F.concat(F.lit("短期实习（"), m, F.lit("）≤ 3 月，建议合并或删除")))
    often = F.filter(F.array_distinct(skills), lambda s: F.size(F.filter(skills, lambda o: o == s)) >= 3)
    lines = {
        "experience": "工作经历段落总行数最多，建议精简描述 / 删除最早一段", "projects": "项目经历段落总行数最多，建议只保留 2-3 个最相关的项目",
        "achievements": "独立成果数据条目过多（>5 条），建议合并相似项",
    }
    found = F.concat(
        F.when(low.isNotNull(), F.array(F.concat(F.lit("GPA "), low.cast("string"), F.lit(" 低于 3.0，建议删除 GPA 字段")))).otherwise(F.array().cast(texts)), short,
        F.when(F.size(often) > 0, F.array(F.concat(F.lit("重复技能 "), F.array_join(F.slice(often, 1, 3), ", "), F.lit(" 出现 ≥ 3 次，可去重")))).otherwise(F.array().cast(texts)),
        *[F.when(F.array_contains(longest, name), F.array(F.lit(line))).otherwise(F.array().cast(texts)) for name, line in lines.items()],
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("简历超出一页，建议精简整体内容")))


def rule_score(resume: Column, job: Column, years: Column) -> Column:
    """Share of the job's skills in percent, half without skills, ten up or down by experience."""
    base = F.when(F.size(job) > 0, F.floor(F.size(F.array_intersect(resume, job)) / F.size(job) * 100)).otherwise(50)
    return F.when(years >= 3, F.least(base + 10, F.lit(100))).when(years < 1, F.greatest(base - 10, F.lit(0))).otherwise(base).cast("int")


def simple_score(resume: Column, job: Column) -> Column:
    share = F.when(F.size(job) > 0, F.size(F.array_intersect(resume, job)) / F.size(job)).otherwise(0.0)
    return F.least(F.lit(1.0), share * 0.4 + 0.3 + 0.2 + 0.1)


def confirmed_skills(claimed: Column, resume: Column) -> Column:
    """Claimed skills that are, or are part of, a skill of the resume."""
    return F.filter(claimed, lambda s: F.exists(resume, lambda t: F.contains(F.lower(t), F.lower(s))))


def confidence(name: Column, phone: Column, email: Column, n_skills: Column, years: Column, n_education: Column, n_projects: Column) -> Column:
    """Points for what could be extracted, 100 at most."""
    parts = [(filled(name), 15), (filled(phone), 15), (filled(email), 10), (n_skills > 0, 20), (years > 0, 10), (n_education > 0, 15), (n_projects > 0, 15)]
    return F.least(F.lit(100), sum((F.when(c, n).otherwise(0) for c, n in parts), F.lit(0)))
