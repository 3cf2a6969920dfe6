"""Rules that read postings and resumes from plain text, as columns inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, strip

#: What \s matches.
BLANKS = " \t\n\x0b\f\r"
#: A word character of any script.
W = r"[\p{L}\p{N}_]"

#: Words of technical skills, by field.
TECH_WORDS = {
    "backend": ("Python", "Java", "Go", "Node.js", "后端", "微服务", "API"),
    "frontend": ("React", "Vue", "Angular", "TypeScript", "前端", "JavaScript"),
    "fullstack": ("全栈", "前后端", "Full Stack"),
    "data": ("Python", "SQL", "机器学习", "数据分析", "Data"),
    "devops": ("Docker", "Kubernetes", "CI/CD", "运维", "DevOps"),
    "mobile": ("iOS", "Android", "Flutter", "React Native", "移动端"),
    "ai": ("机器学习", "深度学习", "NLP", "AI", "LLM", "大模型"),
}
#: Words that hint at traits.
TRAIT_WORDS = {
    "leadership": ("带领", "管理", "负责", "主导", "Leader", "Lead"),
    "teamwork": ("协作", "团队合作", "沟通", "Cross-functional"),
    "problem_solving": ("解决", "挑战", "优化", "性能", "问题"),
    "learning": ("学习", "快速", "新技术", "适应"),
    "pressure": ("压力", " deadline ", "紧张", "加班"),
    "english": ("英文", "English", "英语"),
}
NO_TRAITS = "无明显隐性要求"
#: Patterns of skills; the first group counts.
SKILL_PATTERNS = (
    r"(\d+)\s*年以上", r"精通[\s：:]*(.+?)[，,。.]?", r"熟练[\s：:]*(.+?)[，,。.]?", r"熟悉[\s：:]*(.+?)[，,。.]?", r"掌握[\s：:]*(.+?)[，,。.]?",
    rf"({W}{{2,8}}编程)", rf"({W}{{2,8}}框架)", rf"({W}{{2,8}}语言)", rf"({W}{{2,8}}数据库)", rf"({W}{{2,8}}中间件)",
)
#: What every match of each of these patterns holds.
SKILL_MARKS = ("年以上", "精通", "熟练", "熟悉", "掌握", "编程", "框架", "语言", "数据库", "中间件")
#: Marks before what is nice to have.
WANTED_MARKS = ("加分", "优先", "preferred")
#: Labels of fields, in the order in which they are tried, and what stands for a missing one.
LABELS = {
    "title": (("职位名称", "岗位", "Position", "Title"), "未知职位"),
    "company": (("公司名称", "公司", "Company"), "未知公司"),
    "location": (("工作地点", "地点", "Location"), "未知"),
    "salary": (("薪资", "待遇", "薪酬", "Salary"), "面议"),
}
#: What opens and closes the section of requirements.
ENGLISH_SECTIONS = (r"(?is)Requirements[:\s]*\n(.*?)(?:\n\n|\n\d+\.|\nPreferred|\nQualifications)", r"(?is)Qualifications[:\s]*\n(.*?)(?:\n\n|\n\d+\.|\nPreferred)")
SECTION_OPENS = ("【任职要求】", "【职位要求】", "【岗位要求】", "【要求】", "任职要求", "职位要求", "岗位要求")
SECTION_CLOSES = ("【加分项】", "【优先】", "【职责】", "【职位描述】", "加分项", "职责", "职位描述")
#: Sections of what is preferred.
PREFERRED_SECTIONS = (
    r"(?is)[【\[]加分项[】\]].*?\n(.*?)(?:\n\n|\n[【\[]|\n[一二三四五六七八九十])",
    r"(?is)[【\[]优先[】\]].*?\n(.*?)(?:\n\n|\n[【\[]|\n[一二三四五六七八九十])",
    r"(?is)[【\[]Preferred[【\[][\s]*(?:Qualifications|Requirements)?[】\]].*?\n(.*?)(?:\n\n|\n[【\[]|\n\d+\.)",
    r"(?is)Preferred\s*(?:Qualifications|Requirements)?[：:].*?\n(.*?)(?:\n\n|\n[【\[]|\n\d+\.|\n[A-Z][a-z]+:)",
)
#: Marks of the line that opens duties, and requirements.
DUTY_MARKS, NEED_MARKS = ("职责", "responsibilit", "工作内容", "你要做"), ("要求", "requirement", "任职", "你需要", "qualification")
BULLET = r"^[•·\-]\s*|^\d+[.、)]\s*"
#: Headings of a resume's sections.
RESUME_SECTIONS = {
    "experience": ("work experience", "work history", "professional experience", "employment", "工作经历", "工作经验", "职业经历", "employment history", "career history"),
    "projects": ("projects", "project experience", "key projects", "ai projects", "项目经验", "项目经历", "project highlights", "notable projects"),
    "skills": ("skills", "core competencies", "technical skills", "competencies", "技能", "个人优势", "专业技能", "competencies", "skill summary"),
    "education": ("education", "educational background", "academic background", "教育经历", "教育背景", "学历", "academic experience"),
}
HEADING_CHARS = 60
#: Fields that each entry of a section needs, with their labels.
REQUIRED_FIELDS = {
    "experience": (("company", "公司"), ("title", "职位"), ("duration", "起止时间"), ("achievements", "至少 1 个成果")),
    "projects": (("name", "项目名"), ("role", "你的角色"), ("tech_stack", "技术栈"), ("description", "做了什么"), ("achievements", "主要成果")),
}
#: Words of lines that hold no posting.
NO_POSTING = ("验证码", "登录", "注册", "人机验证", "请输入", "Copyright")


def either(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests)


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches; none in a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def first_filled(*lists: Column) -> Column:
    """The first list that isn't empty, else an empty one."""
    return F.coalesce(*[let(x, lambda found: F.when(F.size(found) > 0, found)) for x in lists], F.array().cast("array<string>"))


# -- skills -----------------------------------------------------------------------------------------------


def skills_by_rule(text: Column, most: int = 20) -> Column:
    """What the patterns find, pattern by pattern, each once. A text is searched for the patterns whose mark it
    holds alone: those that begin with any word try each of its characters."""
    marked = [found(F.when(text.contains(m), text), p) for m, p in zip(SKILL_MARKS, SKILL_PATTERNS, strict=True)]
    return F.slice(F.array_distinct(F.concat(*marked)), 1, most)


def wanted_skills(text: Column, most: int = 10, reach: int = 200) -> Column:
    """Words after the first of each mark of what is nice to have."""
    parts = [F.when(F.locate(m, text) > 0, F.substr(text, F.locate(m, text), F.lit(reach))).otherwise("") for m in WANTED_MARKS]
    return F.slice(F.array_distinct(F.concat(*[found(p, rf"({W}{{2,8}})") for p in parts])), 1, most)


def tech_words(text: Column) -> Column:
    """Technical words that the text holds, in the order of the fixed values."""
    words = literals([w for words in TECH_WORDS.values() for w in words])
    return F.array_distinct(let(F.lower(text), lambda low: F.filter(words, lambda w: low.contains(F.lower(w)))))


def traits(text: Column) -> Column:
    """A line for each trait, with the words that hint at it."""

    def line(low: Column, name: str) -> Column:
        hits = F.filter(literals(TRAIT_WORDS[name]), lambda w: low.contains(F.lower(w)))
        return let(hits, lambda h: F.when(F.size(h) > 0, F.concat(F.lit(f"{name}: "), F.array_join(h, ", "))))

    def said(low: Column) -> Column:
        return F.array_join(F.array_compact(F.array(*[line(low, name) for name in TRAIT_WORDS])), "\n")

    return let(let(F.lower(text), said), lambda x: F.when(x != "", x).otherwise(NO_TRAITS))


# -- fields and sections of a posting -----------------------------------------------------------------------


def labelled(text: Column, name: str) -> Column:
    """The field after the first label found."""
    labels, default = LABELS[name]
    values = [F.nullif(strip(F.regexp_extract(text, rf"(?i){label}[：:]\s*(.+?)(?:\n|$)", 1)), F.lit("")) for label in labels]
    if name == "title":  # or the first short line of five
        lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), strip)
        values.append(F.get(F.filter(lines, lambda x: (x != "") & (F.length(x) < 50)), 0))
    return F.coalesce(*values, F.lit(default))


def dashes(section: Column, least: int) -> Column:
    return F.filter(F.transform(found(section, r"-\s*(.+?)(?:\n|$)"), strip), lambda x: F.length(x) > least)


def requirements(text: Column, most: int = 10) -> Column:
    """Technical words and dashed lines of the section of requirements, English first."""
    def listed(section: Column) -> Column:
        return let(section, lambda s: F.array_distinct(F.concat(tech_words(s), dashes(s, 5))))

    def closed(rest: Column) -> Column:
        ends = F.array(*[F.nullif(F.locate(c, rest), F.lit(0)) for c in SECTION_CLOSES])
        return strip(F.substr(rest, F.lit(1), F.coalesce(F.array_min(ends) - 1, F.length(rest))))

    tries = [listed(F.regexp_extract(text, p, 1)) for p in ENGLISH_SECTIONS]
    for mark in SECTION_OPENS:
        rest = F.when(F.locate(mark, text) > 0, F.substr(text, F.locate(mark, text) + len(mark))).otherwise("")
        tries.append(listed(let(rest, closed)))
    return F.slice(first_filled(*tries), 1, most)


def preferred(text: Column, most: int = 5) -> Column:
    """Numbered and dashed lines of the section of what is preferred."""
    def listed(section: Column) -> Column:
        numbered = lambda s: F.transform(found(s, r"[一二三四五六七八九十\d][\.、]\s*(.+?)(?:\n|$)"), strip)
        return let(section, lambda s: F.array_distinct(F.concat(F.filter(numbered(s), lambda x: F.length(x) > 3), dashes(s, 3))))

    return F.slice(first_filled(*[listed(F.regexp_extract(text, p, 1)) for p in PREFERRED_SECTIONS]), 1, most)


def duties_and_needs(text: Column) -> Column:
    """responsibilities and requirements: bulleted lines by the last heading line before them. Each line is looked
    at once: a heading's items are the slice up to the next one."""
    trim = lambda x: F.btrim(x, F.lit(BLANKS))
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")

    def marked(x: Column, i: Column) -> Column:
        mark = let(F.lower(x), lambda low: F.when(either([low.contains(m) for m in DUTY_MARKS]), "duty").when(either([low.contains(m) for m in NEED_MARKS]), "need"))
        item = let(F.regexp_replace(x, BULLET, ""), lambda rest: F.when(rest != x, trim(rest)))
        return F.struct(i.alias("i"), mark.alias("mark"), item.alias("item"))

    def split(rows: Column) -> Column:
        # before the first heading are duties; the last one ends the text
        first, end = (F.array(F.struct(i.cast("int").alias("i"), F.lit(m).cast("string").alias("mark"))) for i, m in ((F.lit(-1), "duty"), (F.size(rows), None)))
        heads = F.transform(F.filter(rows, lambda r: r["mark"].isNotNull()), lambda r: F.struct(r["i"].alias("i"), r["mark"].alias("mark")))
        return let(F.concat(first, heads, end), lambda heads: F.struct(of(rows, heads, "duty").alias("responsibilities"), of(rows, heads, "need").alias("requirements")))

    def of(rows: Column, heads: Column, kind: str) -> Column:
        own = lambda h, k: F.when(h["mark"] == kind, F.slice(rows, h["i"] + 2, F.get(heads, k + 1)["i"] - h["i"] - 1))
        items = F.transform(F.flatten(F.filter(F.transform(heads, own), lambda x: x.isNotNull())), lambda r: r["item"])
        return F.filter(items, lambda x: x != "")

    return let(F.transform(lines, marked), split)


def line_record(line: Column) -> Column:
    """url, job, title, company of a line that names a posting, else null."""
    x = strip(line)
    url = F.regexp_extract(x, r"(https?://[^\s|]+/job/\d+\.s?html)", 1)
    title = F.substring(strip(F.when(url != "", F.split_part(x, url, F.lit(1)))), 1, 120)
    fits = (F.length(x) >= 5) & ~either([x.contains(w) for w in NO_POSTING]) & (url != "") & (F.length(title) > 2)
    job = F.coalesce(F.nullif(F.regexp_extract(url, r"/job/(\d+)", 1), F.lit("")), F.regexp_replace(F.regexp_extract(url, r"([^/]*)$", 1), r"\.html", ""))
    company = strip(F.regexp_extract(x, r"公司[：:]\s*([^\n|]{2,40})", 1))
    return F.when(fits, F.struct(url.alias("url"), job.alias("job"), title.alias("title"), company.alias("company")))


def query_forms(title: Column, raw: Column) -> Column:
    """A short, a medium and a long query for a posting."""
    bare = strip(F.regexp_replace(title, r"\([^)]*\)", ""))
    raw = F.coalesce(raw, F.lit(""))
    first = F.substring(strip(F.get(F.split(raw, r"[。\n\.!?;]", 2), 0)), 1, 30)
    short = F.coalesce(F.nullif(strip(F.substring(bare, 1, 25)), F.lit("")), F.substring(title, 1, 25))
    medium = F.when((first != "") & ~F.contains(bare, first), strip(F.substring(F.concat(bare, F.lit(" "), first), 1, 60))).otherwise(F.substring(bare, 1, 50))
    start = strip(F.substring(F.replace(raw, F.lit("\n"), F.lit(" ")), 1, 80))
    return F.struct(short.alias("short"), medium.alias("medium"), strip(F.substring(F.concat(bare, F.lit(" 岗位，要求"), start), 1, 120)).alias("long"))


# -- resumes ------------------------------------------------------------------------------------------------


def resume_sections(text: Column) -> Column:
    """section, first_line (its heading) and n_lines (up to the next section) of the sections found."""
    lines = F.split(text, "\n")
    starts = []
    for name, words in RESUME_SECTIONS.items():

        def is_head(x: Column) -> Column:
            return (F.length(x) < HEADING_CHARS) & either([F.lower(x).contains(w) for w in dict.fromkeys(words)])  # noqa: B023

        heads = F.transform(lines, is_head)
        starts.append(F.struct(F.lit(name).alias("section"), (F.array_position(heads, F.lit(True)) - 1).cast("int").alias("first_line")))
    known = F.filter(F.array(*starts), lambda s: s["first_line"] >= 0)

    def sized(known: Column) -> Column:
        def one(s: Column) -> Column:
            later = F.transform(F.filter(known, lambda o: o["first_line"] > s["first_line"]), lambda o: o["first_line"])
            end = F.coalesce(F.array_min(later), F.size(lines))
            return F.struct(s["section"].alias("section"), s["first_line"].alias("first_line"), (end - s["first_line"] - 1).alias("n_lines"))

        return F.transform(known, one)

    return F.get(F.transform(F.array(known), sized), 0)


def completeness(name: Column, email: Column, phone: Column, n_experience: Column, n_skills: Column, n_education: Column) -> Column:
    """score, complete, missing, issues of a resume that was read."""
    tests = [
        (blank(name) | (name == "Unknown"), "姓名", "未找到姓名信息"), (blank(email), "邮箱", "未找到邮箱地址"), (blank(phone), None, "未找到电话号码"),
        (n_experience == 0, "工作经历", "未找到工作经历"), (n_skills == 0, "技能", "未找到技能信息"), (n_education == 0, "教育背景", "未找到教育背景"),
    ]
    missing = F.array_compact(F.array(*[F.when(c, m) for c, m, _ in tests if m]))
    score = F.greatest(F.lit(0.0), (5 - F.size(missing)) / F.lit(5.0))
    return F.struct(score.alias("score"), (score >= 0.8).alias("complete"), missing.alias("missing"), F.array_compact(F.array(*[F.when(c, i) for c, _, i in tests])).alias("issues"))


def profile_check(name: Column, email: Column, n_skills: Column, years: Column) -> Column:
    """score, valid and the list of issues of a profile."""
    tests = [(blank(name) | (name == "未知"), "姓名缺失"), (blank(email), "邮箱缺失"), (F.coalesce(n_skills, F.lit(0)) == 0, "技能列表为空"), (F.coalesce(years, F.lit(0)) < 0, "工作年限异常")]
    issues = F.array_compact(F.array(*[F.when(c, i) for c, i in tests]))
    score = (10 - F.size(issues)) / F.lit(10.0)
    return F.struct(score.alias("score"), (score >= 0.7).alias("valid"), issues.alias("issues"))


def lacking(items: Column, section: str, lists: Sequence[str] = ("achievements", "tech_stack")) -> Column:
    """Labels, with the entry's number, of the required fields that entries lack."""
    entry, none = ("第 {} 段工作经历", "至少 1 段工作经历") if section == "experience" else ("第 {} 个项目", "至少 1 段项目")
    before, after = entry.split("{}")

    def of(e: Column, i: Column) -> Column:
        where = F.concat(F.lit(before), i + 1, F.lit(f"{after}："))
        has = lambda f: F.exists(F.coalesce(e[f], F.array().cast("array<string>")), lambda v: ~blank(v)) if f in lists else ~blank(e[f])
        return F.array_compact(F.array(*[F.when(~has(f), F.concat(where, F.lit(label))) for f, label in REQUIRED_FIELDS[section]]))

    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, literals([none])).otherwise(F.flatten(F.transform(items, of)))


def empty_sections(experience: Column, projects: Column, achievements: Column) -> Column:
    """Names of the sections that say nothing."""
    says = lambda items, *fields: F.coalesce(F.exists(items, lambda e: either([~blank(e[f]) for f in fields])), F.lit(False))
    tests = [(~says(experience, "company", "description"), "experience"), (~says(projects, "name", "description"), "projects"), (F.coalesce(F.size(achievements), F.lit(0)) <= 0, "achievements")]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in tests]))


def contact_issues(email: Column, phone: Column) -> Column:
    """Which of email and phone are malformed."""
    digits = F.regexp_replace(phone, "[ -]", "")
    bad_email = ~(email.contains("@") & F.element_at(F.split(email, "@"), -1).contains("."))
    bad_phone = ~F.regexp_like(digits, F.lit("^[0-9]{11,}$"))
    return F.array_compact(F.array(F.when(F.coalesce(bad_email, F.lit(True)), "email"), F.when(F.coalesce(bad_phone, F.lit(True)), "phone")))
