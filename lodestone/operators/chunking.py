"""Documents to typed chunks: lines, sections and units as islands, then sentence packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

LEAST, MOST, HEADING_MOST = 8, 800, 40

#: Headings of each type, as regular expressions; the first type that matches counts.
HEADINGS = {
    "nice_to_have": ("加分项", "优先考虑", "优先", r"nice\s*to\s*have", "bonus", "preferred", "plus", r"good\s*to\s*have"),
    "responsibility": ("岗位职责", "工作职责", "工作内容", "主要职责", "职责描述", "你将", "你的工作", "responsibilities", r"what\s*you[' ]ll\s*do", r"key\s*responsibilities", r"the\s*role", r"role\s*description", "duties"),
    "requirement": ("任职要求", "岗位要求", "招聘要求", "任职资格", "岗位资格", "应聘条件", "要求", "requirements", "qualifications", r"required\s*skills", r"must\s*have", r"who\s*you\s*are", r"what\s*we[' ]re\s*looking\s*for", r"skills?\s*&?\s*experience"),
    "overview": ("关于公司", "公司介绍", "公司简介", r"about(\s*us)?", r"company\s*overview", "职位描述", "岗位介绍", "岗位描述", r"job\s*description", "overview", "summary", r"about\s*the\s*role", r"about\s*the\s*job"),
}
BULLET = r"^\s*[•\-*·▪◦‣⁃►▶]\s+|^\s*[0-9]+[.、)）]\s+"


def heading_type(line: Column) -> Column:
    """Type that a heading line opens; null for other lines and lines over HEADING_MOST characters."""
    out = F.lit(None).cast("string")
    for name, phrases in reversed(HEADINGS.items()):
        out = F.when(F.regexp_like(line, F.lit(rf"(?i)^\s*[•\-*0-9.)(]*\s*({'|'.join(phrases)})[:：\s]*$")), name).otherwise(out)
    return F.when(F.length(line) <= HEADING_MOST, out)


def strip_bullet(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BULLET, ""))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "line")).withColumn("line", F.rtrim("line"))


def sections(lines: DataFrame, key: str, opens: Column) -> DataFrame:
    """Add section, the running count of headings, its kind and heading; ``opens`` is null for body lines."""
    w = Window.partitionBy(key).orderBy("at")
    marked = lines.withColumn("opens", opens)
    return marked.withColumns({
        "section": F.sum(F.col("opens").isNotNull().cast("int")).over(w),
        "kind": F.coalesce(F.last("opens", ignorenulls=True).over(w), F.lit("overview")),
        "heading": F.last(F.when(F.col("opens").isNotNull(), F.trim("line")), ignorenulls=True).over(w),
    })


def units(sectioned: DataFrame, key: str) -> DataFrame:
    """Bullets one by one, other neighbouring lines together: key, section, kind, heading, at, text."""
    w = Window.partitionBy(key).orderBy("at")
    bullet, blank, head = F.regexp_like("line", F.lit(BULLET)), F.trim("line") == "", F.col("opens").isNotNull()
    rows = sectioned.withColumns({"bullet": bullet, "cut": bullet | blank | head})
    rows = rows.withColumn("unit", F.sum((F.col("cut") | F.coalesce(F.lag("cut").over(w), F.lit(True))).cast("int")).over(w))
    body = rows.where(~head & ~blank).withColumn("line", F.when(F.col("bullet"), strip_bullet(F.col("line"))).otherwise(F.col("line")))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n")
    return body.groupBy(key, "section", "kind", "heading", "unit").agg(F.min("at").alias("at"), strip(joined).alias("text"))


ASCII_SPACE = " \t\n\x0b\x0c\r"
_BREAK = re.compile(r"\r\n|\n|\r")
_BULLET = re.compile(BULLET, re.A)
_OPENS = {name: re.compile(rf"^\s*[•\-*0-9.)(]*\s*({'|'.join(phrases)})[:：\s]*$", re.A | re.I) for name, phrases in HEADINGS.items()}
_SENTENCE = re.compile(r"(?<=[。.!?！？])\s+", re.A)


def opened(line: str) -> str | None:
    """``heading_type`` of a line."""
    return next((name for name, form in _OPENS.items() if form.search(line)), None) if len(line) <= HEADING_MOST else None


def units_of(text: str) -> Iterator[tuple[str, str | None, str]]:
    """kind, heading and text of each unit of LEAST characters and more, in order: bullets one by one, other
    neighbouring lines together. Each line is looked at once."""
    kind, heading, run = "overview", None, []

    def unit(said: str) -> Iterator[tuple[str, str | None, str]]:
        said = said.strip(ASCII_SPACE)
        if len(said) >= LEAST:
            yield kind, heading, said

    for line in _BREAK.split(text):
        line = line.rstrip(" ")
        opens, bullet, blank = opened(line.strip(" ")), _BULLET.search(line), not line.strip(" ")
        if not (opens or bullet or blank):
            run.append(line)
            continue
        yield from unit("\n".join(run))
        run = []
        if opens:
            kind, heading = opens, line.strip(" ")
        elif bullet and not blank:
            yield from unit(_BULLET.sub("", line).strip(" "))
    yield from unit("\n".join(run))


def packed(text: str, most: int = MOST) -> Iterator[str]:
    """Sentences packed up to ``most`` characters; a text that fits stays as it is."""
    if len(text) <= most:
        yield text
        return
    open_ = ""
    for part in _SENTENCE.split(text):
        if len(open_) + len(part) <= most:
            open_ = f"{open_} {part}".strip(" ") if open_ else part
            continue
        if open_:
            yield open_
        open_ = part
    if open_:
        yield open_


@F.udtf(returnType="chunk_index int, chunk_type string, heading string, chunk_text string", useArrow=True)
class Chunks:
    """Table function of a text's chunks."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str | None, str]]:
        n = 0
        for kind, heading, said in units_of(text or ""):
            for piece in packed(said):
                yield n, kind, heading, piece
                n += 1
        whole = (text or "").strip(ASCII_SPACE)
        if not n and whole:
            yield 0, "overview", None, whole[:MOST]


def chunk_documents(docs: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """key, chunk_index, chunk_type, heading_path, chunk_text. Texts without any chunk give one overview;
    null and blank ones none.

    A lateral join with a table function, in Arrow batches where the rows are: no text is shuffled, and
    the work is linear in it.
    """
    rows = docs.select(key, F.col(text).alias("_text")).lateralJoin(Chunks(F.col("_text").outer()))
    path = F.when(F.col("heading").isNull(), F.array().cast("array<string>")).otherwise(F.array("heading"))
    return rows.select(key, "chunk_index", "chunk_type", path.alias("heading_path"), "chunk_text")
