"""Scalar functions over text columns: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
CJK_WIDE = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"

#: Words of login walls and bot checks.
ANTI_BOT = (
    "验证码", "captcha", "verify", "verification", "请先登录", "登录 / 注册", "登录/注册", "人机验证", "安全验证", "需要验证", "访问异常", "频繁访问",
    "security check", "access denied", "blocked", "manual auth",
)
#: Titles that are no title.
WALL_TITLES = ("登录", "登录 / 注册", "访问异常", "安全验证", "人机验证")
#: Sources filled by crawlers.
CRAWLED = ("liepin_batch", "jobsdb_batch", "smart_collector", "crawler", "jd_crawler", "51job_batch")
#: Skills that are looked up by name.
SKILLS = (
    "Python", "Java", "JavaScript", "C++", "C#", "Go", "Rust", "SQL", "MongoDB", "Redis", "PostgreSQL", "MySQL", "React", "Vue", "Angular", "Node.js",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Machine Learning", "ML", "AI", "Deep Learning", "NLP", "Data Science", "Data Analysis", "ETL",
    "Project Management", "Agile", "Scrum", "Product Manager",
)


def either(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), body), 0)


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """The text holds one of the words, whatever the case."""
    return F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: either(*[low.contains(w.lower()) for w in words]))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def json_list(text: Column, kind: str = "string") -> Column:
    """List in JSON; null and malformed give an empty one."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def json_number(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}").try_cast("double")


def band(value: Column, least: Sequence[tuple[float, str]], other: str) -> Column:
    """Label of the first bound that the value reaches; null gives ``other``."""
    out = F.lit(other)
    for bound, label in reversed(least):
        out = F.when(value >= bound, label).otherwise(out)
    return out


def above(value: Column, bounds: Sequence[tuple[float, str]], other: str) -> Column:
    """Label of the first bound that the value exceeds."""
    out = F.lit(other)
    for bound, label in reversed(bounds):
        out = F.when(value > bound, label).otherwise(out)
    return out


def stars(quality: Column) -> Column:
    return F.when(quality.isNull(), "unrated").otherwise(band(quality, [(0.7, "4"), (0.5, "3"), (0.3, "2")], "1"))


# -- addresses ----------------------------------------------------------------------------------------


def strip_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def normalize_url(url: Column) -> Column:
    """Up to the numbered posting, or without query and fragment."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"(https?://[^/]+/job/[0-9]+)", 1), F.lit("")), strip_url(url))


def job_id(url: Column) -> Column:
    """Number of the posting, or the last part of the path."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/job/([0-9]+)", 1), F.lit("")), F.regexp_extract(strip_url(url), r"([^/]*)/?$", 1))


# -- language and size ----------------------------------------------------------------------------------


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def detect_language(text: Column) -> Column:
    """zh, en or mixed by the share of CJK characters; short texts are mixed."""
    share = count(text, CJK_WIDE) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 20, "mixed").when(share > 0.3, "zh").when(share < 0.05, "en").otherwise("mixed")


def is_zh(text: Column) -> Column:
    """Over a fifth of the characters are CJK or its punctuation."""
    return F.coalesce(count(text, r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}]") / F.nullif(F.length(text), F.lit(0)) > 0.2, F.lit(False))


def non_blank_language(text: Column) -> Column:
    """zh or en by the share of CJK among characters other than blanks; unknown without any."""
    n = F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))
    return F.when(n == 0, "unknown").when(count(text, CJK_WIDE) / n > 0.3, "zh").otherwise("en")


def is_english(text: Column) -> Column:
    return F.coalesce(count(text, "[a-zA-Z]") / F.nullif(F.length(text), F.lit(0)) > 0.7, F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and single CJK characters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z0-9]+|{CJK}"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """CJK 1.5 each; letters, digits and common marks 0.25; anything else 0.5; rounded down."""
    cjk, light = count(text, CJK), count(text, r"[\p{L}\p{N} .,!?\-]") - count(text, CJK)
    rest = F.length(F.coalesce(text, F.lit(""))) - cjk - light
    return F.floor(cjk * 1.5 + light * 0.25 + rest * 0.5).cast("bigint")


# -- cleaning -------------------------------------------------------------------------------------------


def clean_text(text: Column) -> Column:
    """Collapse blank lines and blanks, drop page numbers and control characters, normalise line ends."""
    steps = [
        (r"\n\s*\n", "\n\n"), (r"[ \t]+", " "), (r"第\s*[0-9]+\s*页", ""), (r"Page\s*[0-9]+", ""),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), (r"\r\n", "\n"), (r"\r", "\n"),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_thinking(text: Column) -> Column:
    """Without reasoning fences and tags; other fences stay."""
    names = "think|reasoning|reflection|chain_of_thought"
    text = strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?is)```(?:thinking|reasoning|reflection|chain_of_thought)\b.*?```", ""))
    return strip(F.regexp_replace(text, rf"(?is)<(?:{names})\b[^>]*>.*?</(?:{names})\s*>", ""))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0))


def phones(text: Column) -> Column:
    """Numbers by three patterns, distinct and sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"1[3-9][0-9]{9}", r"[0-9]{3,4}-[0-9]{7,8}", r"[0-9]{11}")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def section(text: Column, pattern: str) -> Column:
    """First group of the pattern, stripped; null where it isn't found."""
    return F.when(F.regexp_like(text, F.lit(f"(?is){pattern}")), strip(F.regexp_extract(text, f"(?is){pattern}", 1)))


def excerpt(text: Column, words: int) -> Column:
    """The first words, with an ellipsis if there are more; a short text stays as it is."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("…"))).otherwise(text)


def summarize(text: Column, most: int) -> Column:
    """The first ``most`` characters of one line, cut at the last blank, with an ellipsis."""
    one = strip(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(one, 1, most)
    cut = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))


#: Marks that end a sentence, in the order in which they are tried.
SENTENCE_ENDS = ("。", ".", "！", "!", "?", "\n")


def truncate_sentence(text: Column, most: int) -> Column:
    """Cut after the last of the first mark that is beyond a third of ``most``, else with an ellipsis."""
    head = F.substring(text, 1, most)
    out = F.when(F.length(text) <= most, text)
    for mark in SENTENCE_ENDS:
        at = F.length(head) - F.instr(F.reverse(head), mark) + 1  # place of the last one
        out = out.when(F.contains(head, F.lit(mark)) & (at - 1 > most // 3), F.substr(head, F.lit(1), at))
    return out.otherwise(F.concat(head, F.lit("…")))


def pack_parts(parts: Column, most: int, joiner: str) -> Column:
    """Join parts greedily while they fit into ``most`` characters; a longer part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(part) <= most
        joined = F.when(acc["open"] == "", part).otherwise(F.trim(F.concat(acc["open"], F.lit(joiner), part)) if joiner == " " else F.concat(acc["open"], F.lit(joiner), part))
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def split_long_text(text: Column, most: int = 4000) -> Column:
    """Paragraphs packed up to ``most`` characters; separators stay with what is before them."""
    parts = F.filter(F.split(F.regexp_replace(text, r"(\n\s*\n)", "\x00$1\x00"), "\x00"), lambda x: x != "")
    return pack_parts(parts, most, "")


def cap_length(text: Column, most: int = 800) -> Column:
    """Sentences packed up to ``most`` characters; a text that fits stays as it is."""
    return F.when(F.length(text) <= most, F.array(text)).otherwise(pack_parts(F.split(text, r"(?<=[。.!?！？])\s+"), most, " "))


# -- money and dates ------------------------------------------------------------------------------------


def number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def salary_range(text: Column) -> Column:
    """Two numbers, or one as both ends."""
    low, high = number(text, r"([0-9]+)[^0-9]+([0-9]+)", 1), number(text, r"([0-9]+)[^0-9]+([0-9]+)", 2)
    one = number(text, r"([0-9]+)", 1)
    return F.struct(F.coalesce(low, one).alias("low"), F.coalesce(high, one).alias("high"))


def salary_k(text: Column) -> Column:
    """a-bK, aK and above, aK and below, aK; open ends are null."""
    t = F.regexp_replace(text, r"[薪\s]", "")
    pair, over, under, one = r"(?i)([0-9]+)-([0-9]+)K?", r"(?i)([0-9]+)K以上", r"(?i)([0-9]+)K以下", r"(?i)([0-9]+)K"
    like = lambda p: F.regexp_like(t, F.lit(p))
    low = F.when(like(pair), number(t, pair, 1)).when(like(over), number(t, over, 1)).when(like(under), F.lit(None).cast("int")).otherwise(number(t, one, 1))
    high = F.when(like(pair), number(t, pair, 2)).when(like(over), F.lit(None).cast("int")).when(like(under), number(t, under, 1)).otherwise(number(t, one, 1))
    return F.struct(low.alias("low"), high.alias("high"))


def salary_thousands(text: Column) -> Column:
    """Numbers with commas, in thousands; a K anywhere multiplies by 1000 first."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9,]+"), F.lit(0))
    one = lambda i: F.regexp_replace(F.get(found, F.lit(i)), ",", "").try_cast("bigint") * F.when(F.lower(text).contains("k"), 1000).otherwise(1)
    low, high = one(0), F.coalesce(one(1), one(0))
    return F.struct(F.floor(low / 1000).cast("int").alias("low"), F.floor(high / 1000).cast("int").alias("high"))


def days_old(text: Column) -> Column:
    return (
        F.when(F.regexp_like(text, F.lit(r"Posted [0-9]+d\+? ago")), number(text, r"Posted ([0-9]+)d\+? ago", 1))
        .when(F.regexp_like(text, F.lit(r"Posted [0-9]+w ago")), number(text, r"Posted ([0-9]+)w ago", 1) * 7)
        .when(text.contains("Posted yesterday"), 1)
        .when(text.contains("Posted today"), 0)
        .otherwise(number(F.lower(text), r"([0-9]+)d\+?\s+ago", 1))
    )


# -- postings ---------------------------------------------------------------------------------------------


def skills_in(text: Column, names: Sequence[str] = SKILLS) -> Column:
    """Names that the text holds, whatever the case, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: low.contains(F.lower(n))))


def is_garbage(source: str, title: str, company: str, raw_text: str, position: Column, crawled: Sequence[str] = CRAWLED, words: Sequence[str] = ANTI_BOT) -> Column:
    """A crawled row with words of a bot check and a weak sign of being a posting."""
    weak = either(F.length(strip(F.coalesce(raw_text, F.lit("")))) < 300, blank(F.col(title)), blank(F.col(company)), F.coalesce(F.trim(title).isin(*WALL_TITLES), F.lit(False)), position.isNull())
    return F.coalesce(F.col(source).isin(*crawled), F.lit(False)) & holds_any(F.concat_ws("\n", title, company, raw_text), words) & weak


def route(text: Column, branches: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """Name of the first branch of which the text holds a word."""
    out = F.lit(other)
    for name, words in reversed(branches):
        out = F.when(holds_any(text, words), name).otherwise(out)
    return out


#: Words of titles by type of document, and the type without any; branches of a chat message
#: by words (those marked long count in messages over LONG_MESSAGE characters alone), in their order.
DOC_TYPES = (
    ("个人简历", ("resume", "cv ", "简历", "简历 ")), ("职位描述", ("jd", "job description", "职位描述", "招聘 ")), ("政策文件", ("policy", "政策", "规定")), ("研究报告", ("report", "报告")),
)
DOC_TYPE_KEYS, ANY_DOC_TYPE = ("document_type", "doc_type", "type"), "文档内容"
LONG_MESSAGE = 100
CHAT_BRANCHES = (
    ("match", False, ("匹配", "匹配度", "match", "分析匹配", "看看匹配")), ("state", False, ("状态", "state", "当前状态", "当前")), ("parse_resume", False, (".pdf", ".docx", ".md", ".txt")),
    ("parse_resume", False, ("解析简历", "parse resume", "读简历")), ("analyze_jd", True, ("职位", "jd", "job", "要求", "职责")), ("analyze_jd", False, ("分析jd", "分析职位", "analyze jd")),
    ("workflow", False, ("完整工作流", "优化简历", "生成简历", "cover letter", "求职信", "完整流程", "帮我申请", "run workflow")),
)


def doc_type(metadata: Column) -> Column:
    """Type of a document from its metadata, a variant: a named one, else by words of its title."""
    named = [F.nullif(F.try_variant_get(metadata, f"$.{k}", "string"), F.lit("")) for k in DOC_TYPE_KEYS]
    return F.coalesce(*named, route(F.try_variant_get(metadata, "$.document_title", "string"), DOC_TYPES, ANY_DOC_TYPE))


def chat_branch(message: Column) -> Column:
    """Branch of a chat message by its words; ``model`` where none decides."""
    out = F.lit("model")
    for name, long, words in reversed(CHAT_BRANCHES):
        hit = holds_any(message, words)
        out = F.when(hit & (F.char_length(message) > LONG_MESSAGE) if long else hit, name).otherwise(out)
    return out


def chunk_id(source: Column, page: Column, seq: Column, prefix: str = "chunk") -> Column:
    return F.concat_ws("_", F.lit(prefix), F.regexp_replace(source, r"[^A-Za-z0-9]+", "-"), page.cast("string"), F.lpad(seq.cast("string"), 4, "0"))


def filename(*parts: Column, extension: str = "docx") -> Column:
    safe = [F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(p, r'[\\/:*?"<>|\r\n\t]+', ""), r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("未命名")) for p in parts]
    return F.concat(F.concat_ws("_", *safe), F.lit(f".{extension}"))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clamp_scores(scores: Column, n: int, low: int = 1, high: int = 5, missing: int = 3) -> Column:
    """Scores within bounds, ``n`` of them; missing ones are filled up."""
    inside = F.transform(scores, lambda x: F.when(x.isNull(), missing).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x))))
    return F.slice(F.concat(F.coalesce(inside, F.array().cast("array<int>")), F.array_repeat(F.lit(missing), n)), 1, n)


def loose_json(text: Column) -> Column:
    """The JSON part of a reply: in a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(braces, F.lit("")), text)
