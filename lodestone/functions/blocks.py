"""Blocks of a parsed document: headings, lists, tables, and the context of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Numberings of headings, with their levels; the first that matches counts.
NUMBERINGS = ((r"^\d+\.\d+\.\d+\.\d+\.\s*", 4), (r"^\d+\.\d+\.\d+\.\s*", 3), (r"^\d+\.\d+\.\s*", 2), (r"^\d+\.\s*", 1), (r"^[（(]\d+[）)]\s*", 1), (r"^[IVXLC]+[\.)]\s*", 1))
#: Parts of the names of bold fonts.
BOLD = ("bold", "semibold", "extrabold", "heavy")
LARGE_FONT, LARGE_CHARS, BOLD_CHARS = 14, 80, 100
#: Names of chunk types.
TYPE_LABELS = {"heading": "标题", "paragraph": "正文段落", "table": "表格", "figure": "图片", "footnote": "页眉页脚/脚注", "list": "列表项"}
LIST_LINE = r"^\s*[-*•\d+)]\s+"
CONTEXT_LEAST, CONTEXT_MOST, ABSTRACT = 50, 150, 100


def heading(text: Column, font_size: Column, fonts: Column) -> Column:
    """Level of a heading: by its numbering, a large font, or a bold one; 0 for other text."""
    x = strip(F.coalesce(text, F.lit("")))
    level = F.when(x == "", 0)
    for pattern, n in NUMBERINGS:
        level = level.when(F.regexp_like(x, F.lit(pattern)), n)
    level = level.when((font_size > LARGE_FONT) & (F.length(x) < LARGE_CHARS), 1)
    names = F.array_join(fonts, "")
    return level.when(F.exists(F.array(*[F.lit(b) for b in BOLD]), lambda b: F.contains(names, b)) & (F.length(x) < BOLD_CHARS), 1).otherwise(0)


def looks_like_list(text: Column) -> Column:
    """More than half of two lines or more begin with a bullet or a digit."""
    lines = F.split(strip(text), "\n")
    share = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(LIST_LINE)))) / F.size(lines)
    return (F.size(lines) >= 2) & (share > 0.5)


def looks_like_table(lines: Column) -> Column:
    """lines: lists of spans. Every line with spans has as many, two at least; or one of the first
    two lines has several."""
    counts = F.filter(F.transform(lines, F.size), lambda n: n > 0)
    alike = F.forall(counts, lambda n: n == F.get(counts, 0)) & (F.get(counts, 0) >= 2)
    wide = F.exists(F.slice(lines, 1, 2), lambda x: F.size(x) >= 2)
    return (F.size(lines) >= 2) & (F.size(counts) > 0) & F.coalesce(alike | wide, F.lit(False))


def markdown(lines: Column) -> Column:
    """A table in Markdown: the first row is its header, all rows are as wide as the widest."""
    rows = F.filter(F.transform(lines, lambda x: F.filter(F.transform(x, strip), lambda c: c != "")), lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(rows, F.size))
    said = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    padded = lambda r: said(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = said(F.array_repeat(F.lit("---"), width))
    listed = F.transform(rows, padded)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(listed, 1, 1), F.array(rule), F.slice(listed, 2, 1 << 30)), "\n")).otherwise("")


def abstract(text: Column, most: int = ABSTRACT) -> Column:
    """The first ``most`` characters up to the last blank, full stop and comma, with an ellipsis."""
    x = strip(F.coalesce(text, F.lit("")))
    head = F.substring(x, 1, most)
    for mark in (" ", "。", "，"):
        head = F.regexp_replace(head, rf"(?s){mark}[^{mark}]*$", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(strip(head), F.lit("…")))


def context(doc_type: Column, path: Column, kind: Column, content: Column, before: Column, after: Column) -> Column:
    """Where a chunk stands, in 50 to 150 characters: a long form, a short one, or one with content.
    before and after are null at the document's ends."""
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])[kind], kind)
    whole, last = F.array_join(path, " / "), F.try_element_at(path, F.lit(-1))
    first_page = F.lit("文档首页")
    where, short_where = F.coalesce(F.nullif(whole, F.lit("")), first_page), F.coalesce(last, first_page)
    near = lambda x, none, most: F.when(x.isNull(), none).otherwise(abstract(x, most))
    long = F.concat(F.lit("[文档类型] "), doc_type, F.lit(" | [章节定位] 位于'"), where, F.lit("'，[内容类型] "), label, F.lit("，[上文简介] "), near(before, "无上文", ABSTRACT), F.lit("，[下文预告] "), near(after, "无下文", ABSTRACT))
    short = F.concat(F.lit("[文档类型] "), doc_type, F.lit(" | [章节] "), short_where, F.lit(" | [类型] "), label, F.lit(" | [上文] "), near(before, "无", 30), F.lit(" | [下文] "), near(after, "无", 30))
    own = lambda w: F.concat(F.lit("[文档类型] "), doc_type, F.lit(" | [章节] "), w, F.lit(" | [类型] "), label, F.lit(" | [内容] "), abstract(content, 60))
    return F.when(F.length(long) > CONTEXT_MOST, F.when(F.length(short) < CONTEXT_LEAST, own(short_where)).otherwise(short)).when(F.length(long) < CONTEXT_LEAST, own(where)).otherwise(long)
