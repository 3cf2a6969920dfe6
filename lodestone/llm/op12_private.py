"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds.
DataFrame functions and Spark's own trees only.

1. Generators propose spans: of each kind those of the plain form (BASE), and those of a wider form
   (WIDER: spelled-out or bracketed marks, other separators, numbers without their plus). One pass over
   the texts gives each span with the length of the gap before it and its neighbourhood; sums of these
   lengths are the positions, so texts don't move.
2. A plain span that meets its kind's rule (an address part of at most 255, Luhn's sum, a number of
   digits) is personal data, always.
3. Weak labels: such a span is 1. A plain span that breaks its rule is 0, and so is one of the wider
   form whose normal form does, or which is a piece of a longer token. What is left of the wider form
   is open. All labelled spans, each plain one also rewritten in the ways of the wider form, train
   boosted trees on format and context. Spans alike in features and label are one row with a weight,
   so what the trees read grows with the forms of spans. Each kind and label has the same weight in all.
4. A fifth of these spans, by what they say, is held out of training: by kind, the threshold is the
   lowest score above which at least PRECISION of it is 1. Open spans above it are added, unless they overlap a plain one; of added spans
   that overlap each other the best stays.

Counts and ``base_sha256`` speak of plain spans, ``spans`` of all. Offsets are in code points. Null texts
count as empty. Repeated rows, with or without a doc_id, are searched each. Texts are searched whole;
patterns are linear in them and don't recurse. Where no labelled span has a label, or none is held
out, nothing is added to the plain ones. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spooled, pick, spool

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the plain forms, leftmost and without overlap. Possessive quantifiers and the
#: look-behinds change no match: a run that can't match from its start can't match from inside.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wider forms.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[({] ?(?:at|AT) ?[\])}]| (?:at|AT) ) ?[A-Za-z0-9-]{1,63}+(?:(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]| (?:dot|DOT) )[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?: ?[\[({]? ?(?:\.|dot) ?[\])}]? ?[0-9]{1,4}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+ ?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+|(?:00 ?[0-9]{1,3}[\x20.-])?[(]?[0-9]{2,4}[)]?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4})(?![0-9])",
}
#: What a text must hold for a search to be worth it.
NEEDS = {"email": r"@|[ \[({](?:at|AT)[ \])}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Fixed word lists: words that stand near such data.
NEAR = {"email": "mail|contact|write|reach", "ip": "ip|host|server|addr|login|from", "card": "card|visa|master|credit|debit|pay", "phone": "phone|tel|call|mobile|cell|fax|sms"}
#: Characters of neighbourhood; part held out; share of 1 wanted.
AROUND, HELD_OUT, PRECISION = 24, 5, 0.98
#: SPLITS is above the number of values of any feature, so that trees may split at each of them (of over SPLITS
#: squared distinct rows, Spark takes the places of splits, not the trees, from as many). EVEN is the weight of a
#: kind and label; a task trains on TRAINED_ROWS distinct rows.
TREES, DEPTH, BINS, SPLITS, EVEN, TRAINED_ROWS = 10, 4, 100, 1024, 2000.0, 100_000

FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "n_chars", "n_digits", "n_letters", "n_groups", "longest", "largest", "luhn", "distinct_digits", "has_at", "worded", "plus", "norm_chars", "last_label", "glued_before", "glued_after", "near")


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text."""
    return pick(docs, doc_id="bigint", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def searched(rows: DataFrame) -> DataFrame:
    """row, doc_id and the spans of all generators of every row, as an array; spooled, so that a number
    stays with its row."""
    lists = [(kind, form) for kind in KINDS for form in (BASE, WIDER)]
    none = F.array().cast("array<string>")
    found = rows.select(
        "row", "doc_id", "text",
        *[F.when(F.col("text").rlike(NEEDS[kind]), F.regexp_extract_all("text", F.lit(form[kind]), F.lit(0))).otherwise(none).alias(f"said{k}") for k, (kind, form) in enumerate(lists)],
    )
    gaps = found.select("row", "doc_id", *[f"said{k}" for k in range(len(lists))], *[F.when(F.size(f"said{k}") > 0, F.split("text", form[kind], -1)).otherwise(none).alias(f"gaps{k}") for k, (kind, form) in enumerate(lists)])

    def spans(k: int) -> Column:
        n = F.size(f"said{k}")
        both = F.arrays_zip(F.col(f"said{k}"), F.slice(f"gaps{k}", 1, n), F.slice(f"gaps{k}", 2, n))
        first, second, third = f"said{k}", "1", "2"
        return F.transform(both, lambda x, i: F.struct(F.lit(k).alias("list"), i.alias("at"), x[first].alias("said"), F.char_length(x[second]).alias("gap"), F.substring(x[second], -AROUND, AROUND).alias("before"), F.substring(x[third], 1, AROUND).alias("after")))

    return spool(gaps.select("row", "doc_id", F.flatten(F.array(*[spans(k) for k in range(len(lists))])).alias("spans")), "op12-found")


def candidates(found: DataFrame) -> DataFrame:
    """row, kind (place in KINDS), plain, start, end, said, before, after of every span."""
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    before = Window.partitionBy("row", "list").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("said")
    end = F.sum((F.col("gap") + n).cast("bigint")).over(before)
    return each.select("row", F.expr("list div 2").cast("int").alias("kind"), (F.col("list") % 2 == 0).alias("plain"), (end - n).alias("start"), end.alias("end"), "said", "before", "after")


def by_kind(*columns: Column) -> Column:
    out = columns[-1]
    for k, c in reversed(list(enumerate(columns[:-1]))):
        out = F.when(F.col("kind") == k, c).otherwise(out)
    return out


def norm(said: Column) -> Column:
    """A span in its kind's plain form: an address with its marks, else digits (of an ip, with dots)."""
    marks = F.regexp_replace(F.regexp_replace(said, r" ?[\[({] ?(?i:at) ?[\])}] ?| (?i:at) | ?@ ?", "@"), r" ?[\[({] ?(?i:dot) ?[\])}] ?| (?i:dot) ", ".")
    digits = F.regexp_replace(said, "[^0-9]", "")
    return by_kind(marks, F.regexp_replace(F.regexp_replace(said, "[^0-9]+", "."), r"^\.|\.$", ""), digits, digits)


def luhn(digits: Column) -> Column:
    """Luhn's sum of a string of at most 19 digits is a multiple of 10; false for longer ones."""
    doubled = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def described(spans: DataFrame) -> DataFrame:
    """``spans`` (kind, said, before, after) with norm, valid (the rule of their kind) and FEATURES."""
    spans = spans.withColumn("norm", norm(F.col("said")))
    spans = spans.withColumn("digits", F.regexp_replace("norm", "[^0-9]", "")).withColumn("groups", F.regexp_extract_all("said", F.lit("[0-9]+"), F.lit(0)))
    spans = spans.withColumn("luhn", luhn(F.col("digits")))
    n = F.length("digits")
    number = lambda g: F.when(F.length(F.ltrim(g, F.lit("0"))) <= 3, F.coalesce(F.ltrim(g, F.lit("0")).try_cast("int"), F.lit(0))).otherwise(1000)
    spans = spans.withColumn("largest", F.coalesce(F.array_max(F.transform("groups", number)), F.lit(0)))
    valid = by_kind(
        F.col("norm").rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"), (F.col("largest") <= 255) & (F.size("groups") == 4),
        n.between(14, 19) & F.col("luhn"), n.between(10, 15),
    )
    context = F.lower(F.concat("before", F.lit(" "), "after"))
    number_of = lambda c: F.char_length("said") - F.char_length(F.regexp_replace("said", c, ""))
    features = {f"is_{x}": F.col("kind") == k for k, x in enumerate(KINDS)} | {
        "n_chars": F.least(F.char_length("said"), F.lit(200)), "n_digits": F.least(n, F.lit(60)), "n_letters": F.least(number_of("[A-Za-z]"), F.lit(60)), "n_groups": F.least(F.size("groups"), F.lit(20)),
        "longest": F.least(F.coalesce(F.array_max(F.transform("groups", F.length)), F.lit(0)), F.lit(30)), "largest": F.col("largest"), "luhn": F.col("luhn"),
        "distinct_digits": F.size(F.array_distinct(F.split(F.substring("digits", 1, 60), ""))), "has_at": F.col("said").contains("@"), "worded": F.col("said").rlike(r"(?i)[ \[({](?:at|dot)[ \])}]|[\[({]\.[\])}]"),
        "plus": F.col("said").startswith("+"), "norm_chars": F.least(F.char_length("norm"), F.lit(200)), "last_label": F.least(F.char_length(F.substring_index("norm", ".", -1)), F.lit(70)),
        "glued_before": glued(F.col("before"), "$"), "glued_after": glued(F.col("after"), "^"), "near": by_kind(*[context.rlike(rf"(?<![a-z])(?:{NEAR[k]})") for k in KINDS]),
    }
    return spans.withColumn("valid", valid).withColumns({k: v.cast("double") for k, v in features.items()})


def glued(text: Column, end: str) -> Column:
    """The span's neighbour at that end belongs to the same token."""
    mark = "[A-Za-z0-9_=/#\"']"
    return text.rlike(f"{mark}$" if end == "$" else f"^{mark}")


def weak_label(spans: DataFrame) -> DataFrame:
    """label: 1, 0, or null where it is open."""
    piece = (F.col("glued_before") + F.col("glued_after")) > 0
    return spans.withColumn("label", F.when(F.col("plain"), F.col("valid").cast("int")).when(~F.col("valid") | piece, 0))


def rewritten(spans: DataFrame) -> DataFrame:
    """Each plain span in one of the ways of the wider form, by its hash."""
    way, said = F.pmod(F.xxhash64("said", "before"), F.lit(3)), F.col("said")
    digits = F.regexp_replace(said, "[^0-9]", "")
    three = lambda a, b, c: F.when(way == 0, a).when(way == 1, b).otherwise(c)
    put = lambda mark, other: F.replace(said, F.lit(mark), F.lit(other))
    other = by_kind(
        three(F.replace(put("@", " at "), F.lit("."), F.lit(" dot ")), put("@", "[at]"), put("@", " @ ")),
        three(put(".", "[.]"), put(".", " dot "), put(".", " . ")),
        three(*[F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{m}") for m in (".", "/", "_")]),
        three(F.regexp_replace(said, r"^\+[0-9]{1,2}[ .-]?", ""), F.regexp_replace(said, r"^\+", "00"), F.regexp_replace(said, "[ -]", ".")),
    )
    return spans.where("plain").select("kind", "plain", other.alias("said"), "before", "after", "label", "fold")


def learned_from(spans: DataFrame) -> DataFrame:
    """FEATURES, kind, label and fold of every labelled span and of the rewritten plain ones; spans that are
    alike in all of these are one row with their number ``n``."""
    known = spans.where("label is not null").withColumn("fold", F.pmod(F.xxhash64("said"), F.lit(HELD_OUT)).cast("int"))
    columns = ["kind", "label", "fold", *FEATURES]
    both = known.select(columns).unionByName(described(rewritten(known)).select(columns))
    return spool(both.groupBy(columns).agg(F.count("*").alias("n")), "op12-training")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in an order that is always the same, in as many parts as they need."""
    return rows.repartition(-(-rows.count() // TRAINED_ROWS) or 1, *rows.columns).sortWithinPartitions(*rows.columns)


def assembled(spans: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spans)


def scored(model: Model, spans: DataFrame) -> DataFrame:
    return model.transform(assembled(spans)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def trained(rows: DataFrame) -> tuple[Model, dict[int, float]] | None:
    """Boosted trees, and the threshold by kind; None if there is nothing to learn from."""
    fit = rows.where("fold <> 0")
    sizes = {(r.kind, r.label): r.n for r in fit.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}  # eight at most
    if len({label for _, label in sizes}) < 2:
        return None
    weight = F.lit(0.0)
    for (kind, label), n in sizes.items():
        weight = F.when((F.col("kind") == kind) & (F.col("label") == label), F.col("n") * (EVEN / n)).otherwise(weight)
    fit = dealt(fit.select("kind", F.col("label").cast("double").alias("label"), weight.alias("weight"), *FEATURES))
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=SPLITS, seed=1, checkpointInterval=-1)
    model = trees.fit(assembled(fit))
    held = scored(model, rows.where("fold = 0")).select("kind", "label", "n", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    counts = held.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("ones")).collect()  # BINS for each kind
    least = {}
    for kind in range(len(KINDS)):
        n = ones = 0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.bin):
            n, ones = n + r.n, ones + r.ones
            if ones >= PRECISION * n:
                least[kind] = r.bin / BINS
    return model, least


def added(spans: DataFrame, model: Model, least: dict[int, float]) -> DataFrame:
    """row, kind, start, end, score of open spans above their kind's threshold."""
    bar = F.lit(2.0)
    for kind, at in least.items():
        bar = F.when(F.col("kind") == kind, at).otherwise(bar)
    return scored(model, spans.where("label is null")).where(F.col("score") >= bar).select("row", "kind", "start", "end", "score")


def apart(base: DataFrame, more: DataFrame) -> DataFrame:
    """row, kind, start, end, plain: all of ``base``; of ``more`` what overlaps none of it, and the best of
    those that overlap each other, in a chain."""
    both = base.select("row", "kind", "start", "end", F.lit(True).alias("plain"), F.lit(None).cast("double").alias("score")).unionByName(more.withColumn("plain", F.lit(False)))
    order = Window.partitionBy("row").orderBy("start", "end", "plain", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    hit = (F.max(F.when(F.col("plain"), F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(F.col("plain"), F.col("start"))).over(after) < F.col("end"))
    both = both.withColumn("hit", F.coalesce(hit, F.lit(False)))
    base = both.where("plain").select("row", "kind", "start", "end", "plain")
    more = both.where("not plain and not hit")
    more = more.withColumn("new", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)).cast("int"))
    more = more.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("row", "chain").orderBy(F.desc("score"), "start", "end", "kind"))
    return base.unionByName(more.withColumn("best", best).where("best = 1").select("row", "kind", "start", "end", "plain"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans (start, kind, end), by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def chosen(found: DataFrame) -> DataFrame:
    """row, kind, start, end, plain of all personal data of ``searched`` rows."""
    spans = spool(weak_label(described(candidates(found))), "op12-spans")
    base, known = spans.where("plain and valid"), trained(learned_from(spans))
    return base.select("row", "kind", "start", "end", "plain") if known is None else apart(base, added(spans, *known))


def redactions(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs``."""
    found = searched(numbered(docs))
    span = F.struct("start", "kind", "end")
    of = chosen(found).groupBy("row").agg(
        *[F.count_if(F.col("plain") & (F.col("kind") == k)).alias(f"n_{x}") for k, x in enumerate(KINDS)],
        joined(F.collect_list(F.when(F.col("plain"), span))).alias("base"), joined(F.collect_list(span)).alias("spans"),
    )
    out = join_spooled(found.select("row", "doc_id"), spool(of, "op12-chosen"), "row")
    return out.select("doc_id", *[F.coalesce(f"n_{x}", F.lit(0)).cast("bigint").alias(f"n_{x}") for x in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``docs``, with [kind] in place of its personal data; of spans that
    overlap, one place, by the kind of the first."""
    rows = spool(numbered(docs), "op12-texts")
    of = chosen(searched(rows)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = join_spooled(rows, spool(of, "op12-chosen"), "row")
    text, spans, names = F.col("text"), F.col("spans"), F.array(*[F.lit(f"[{k}]") for k in KINDS])
    # what was written so far, and where the text goes on
    step = lambda done, s: F.struct(
        F.when(s.start < done.at, done.out).otherwise(F.concat(done.out, F.substring(text, (done.at + 1).cast("int"), (s.start - done.at).cast("int")), F.element_at(names, s.kind + 1))).alias("out"),
        F.greatest(done.at, s.end).alias("at"),
    )
    tail = lambda done: F.concat(done.out, F.substring(text, (done.at + 1).cast("int"), F.char_length(text)))
    whole = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, tail)
    return out.select("doc_id", F.when(spans.isNull(), text).otherwise(whole).alias("text"))
