"""A training corpus from documents, in stages; each stage's rows are a table that the next one reads.

Stages return all columns of their rows as they came, further ones included, but the last, which packs.
Texts are taken whole. A null text counts as empty: it is neither toxic nor a copy nor a leak, has no
tokens to mix by, and is packed as an end token. Without documents every stage gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_decontaminate, op4_packing, op6_minhash, op7_mixing, op8_toxicity
from lodestone.llm.common import BROADCAST_ROWS, discard, read, spool

#: Share of the tokens left that the mixture may hold.
MIX_PERCENT = 90


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic, learned from the labels outside the held-out fold.

    Each row is judged by its own text, so repeated rows go or stay together, and those without a
    doc_id are judged too. Without labels nothing goes.
    """
    return op8_toxicity.clean_rows(docs, read(spark, sf_dir, "labels")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group of near-duplicates.

    Of rows that repeat a doc_id and text one stays; rows that share a doc_id only go or stay together.
    Rows without a doc_id stay, as they can't be told apart.
    """
    found = spool(op6_minhash.near_duplicates(docs), "pipeline-near")
    drop = spool(found.where("not kept").select("doc_id").distinct(), "pipeline-copies")
    n, named = found.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n > named:
        first = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        docs = first.unionByName(docs.where("doc_id is null"))
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whatever their doc_id. Without items nothing goes."""
    return op1_decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of domains, languages and sources, repeated where an epoch isn't enough.

    A null language or source is one of its own. Rows that share a doc_id share their place in the
    seeded order, and are taken equally often.
    """
    return op7_mixing.mixed_rows(docs, budget_percent=MIX_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of the mixture; repeated rows are packed each, under row numbers of their own."""
    return op4_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("pack", pack),
]

#: Shingle sets, segment search and a tokenizer aren't SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table goes once the next one's is written; the last table stays, as the result reads it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spool(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
