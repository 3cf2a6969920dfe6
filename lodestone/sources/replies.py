"""Rows from the replies of posting sites: nested JSON fields with fall-backs, and pages of HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.postings import either, skills_by_rule, wanted_skills
from ..functions.text import let, strip

#: Addresses that relative links of a site are taken from.
BOSS, LAGOU = "https://www.zhipin.com", "https://www.lagou.com"
#: Words of paragraphs that describe a posting.
DESCRIBING = ("职责", "要求", "描述", "任职", "岗位", "技能", "experience", "requirement", "responsibility")


def pick(reply: Column, *paths: str) -> Column:
    """The first path that holds text, else an empty one."""
    return F.coalesce(*[let(F.get_json_object(reply, f"$.{p}"), lambda x: F.when(x != "", x)) for p in paths], F.lit(""))


def lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[strip(p) for p in parts]), lambda x: x != ""), "\n")


def or_else(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def boss_posting(reply: Column, site: str = BOSS) -> Column:
    """A row from one item of the first site, whose fields may be under job_detail."""
    def fields(base: Column) -> Column:
        return F.struct(
            pick(reply, "id").alias("id"), pick(base, "job_name").alias("title"), pick(base, "company.name", "company_name").alias("company"),
            strip(F.concat(pick(base, "area"), pick(base, "district"))).alias("place"), pick(base, "city_name").alias("city"),
            pick(base, "salary_low").alias("low"), pick(base, "salary_high").alias("high"), pick(base, "salary").alias("salary"),
            pick(base, "job_experience.name", "experience").alias("experience"), pick(base, "job_edu.name", "education").alias("education"),
            pick(base, "description", "job_desc").alias("described"), pick(base, "requirements", "job_require").alias("required"), pick(base, "href").alias("href"),
        )

    def row(f: Column) -> Column:
        return F.struct(
            or_else(strip(f["title"]), "Untitled").alias("title"), or_else(f["company"], "Unknown").alias("company"), F.when(f["place"] != "", f["place"]).otherwise(f["city"]).alias("location"),
            F.when((f["low"] != "") & (f["high"] != ""), F.concat_ws("-", f["low"], f["high"])).otherwise(f["salary"]).alias("salary_str"),
            f["experience"].alias("experience_level"), f["education"].alias("education"), lines(f["described"], f["required"]).alias("raw_text"),
            skills_by_rule(f["required"]).alias("skills_required"), wanted_skills(f["described"]).alias("skills_nice"),
            F.coalesce(F.nullif(f["href"], F.lit("")), F.concat(F.lit(f"{site}/job/detail/"), f["id"], F.lit(".html"))).alias("source_url"),
        )

    # a reply is read once for each field, however often that is used
    return let(let(F.coalesce(F.get_json_object(reply, "$.job_detail"), reply), fields), row)


def lagou_posting(reply: Column, site: str = LAGOU) -> Column:
    """A row from one item of the second site."""
    names = ("positionName", "companyShortName", "companyFullName", "district", "salary", "workYear", "education", "jobDesc", "liability", "skills", "label", "positionAdvantage", "href")
    none = F.array().cast("array<string>")

    def row(f: Column) -> Column:
        link, said = f["href"], lines(f["jobDesc"], f["liability"], f["skills"])
        text = let(said, lambda said: F.when((said == "") & (link != ""), F.concat(F.lit("Detail URL: "), link)).otherwise(said))
        return F.struct(
            or_else(strip(f["positionName"]), "Untitled").alias("title"), F.coalesce(*[F.nullif(f[n], F.lit("")) for n in ("companyShortName", "companyFullName")], F.lit("Unknown")).alias("company"),
            strip(f["district"]).alias("location"), f["salary"].alias("salary_str"), f["workYear"].alias("experience_level"), f["education"].alias("education"),
            F.substring(text, 1, 10_000).alias("raw_text"), F.filter(F.transform(F.split(f["label"], ","), strip), lambda x: x != "").alias("skills_required"),
            F.when(f["positionAdvantage"] != "", F.array(f["positionAdvantage"])).otherwise(none).alias("skills_nice"), F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(site), link)).alias("source_url"),
        )

    return let(F.struct(*[pick(reply, n).alias(n) for n in names]), row)


def bare(html: Column, separator: str = "\n") -> Column:
    """Text of an element: tags go, each run of text is stripped, empty ones go."""
    parts = F.transform(F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>"), strip)
    return F.array_join(F.filter(parts, lambda x: x != ""), separator)


def by_selectors(html: Column, elements: Sequence[str], most: int = 200) -> Column:
    """Text of the first element (as a pattern whose group is its content) that has any, and less than ``most``."""
    tries = []
    for pattern in elements:
        text = bare(F.regexp_extract(html, f"(?is){pattern}", 1), "")
        tries.append(F.when((text != "") & (F.length(text) < most), text))
    return F.coalesce(*tries, F.lit(""))


def description(html: Column, elements: Sequence[str], least: int = 50, most_lines: int = 20) -> Column:
    """Text of the first element with more than ``least`` characters; else the page's lines, without
    scripts and furniture, that are long or describe a posting."""
    tries = []
    for pattern in elements:
        text = bare(F.regexp_extract(html, f"(?is){pattern}", 1))
        tries.append(F.when(F.length(text) > least, text))
    page = bare(F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</(script|style|nav|footer|header)>", ""))
    kept = F.filter(F.split(page, "\n"), lambda x: (F.length(x) > 20) | either([F.lower(x).contains(w) for w in DESCRIBING]))
    return F.coalesce(*tries, F.array_join(F.slice(kept, 1, most_lines), "\n"))


#: Elements of a posting's page at the third site, best first, as patterns of their content.
INDEED = (
    r'<div[^>]*\bid="jobdesc"[^>]*>(.*?)</div>',
    r'<div[^>]*\bclass="(?:[^"]* )?jobsec(?: [^"]*)?"[^>]*>(.*?)</div>',
    r'<div[^>]*\bid="description"[^>]*>(.*?)</div>',
    r'<div[^>]*\bid="[^"]*description[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*\bclass="[^"]*description[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*\bid="jobDescriptionText"[^>]*>(.*?)</div>',
    r'<span[^>]*\bitemprop="description"[^>]*>(.*?)</span>',
    r'<div[^>]*\bclass="(?:[^"]* )?css-1e7z4o5(?: [^"]*)?"[^>]*>(.*?)</div>',
)


def indeed_description(html: Column, least: int = 50, most: int = 10_000) -> Column:
    """Text of the first element with more than ``least`` characters, else of the page's closed paragraphs, a line
    for each, up to ``most`` characters; null without any."""
    tries = []
    for pattern in INDEED:
        text = bare(F.regexp_extract(html, f"(?s){pattern}", 1))
        tries.append(F.when(F.length(text) > least, text))
    paragraphs = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), 1), lambda x: bare(x, "")), lambda x: x != "")
    return F.coalesce(*tries, F.nullif(F.substring(F.array_join(paragraphs, "\n"), 1, most), F.lit("")))
