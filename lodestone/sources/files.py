"""Readers and writers of files: JSON lines, directories of JSON, texts, vectors as bytes."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from .folder import WORD, read_folder

VECTOR = ArrayType(FloatType())

#: What to do with a malformed line.
MODES = {"raise": "FAILFAST", "skip": "DROPMALFORMED", "report": "PERMISSIVE"}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, in a
    temporary one in local mode, in which all tasks share a machine; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside have their shuffle files removed as they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def passing_table(df: DataFrame, name: str) -> DataFrame:
    """A work table of a large step, to be discarded: compressed further, without shuffle files left."""
    path = work_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete passing tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._work_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_jsonl(spark: SparkSession, path: str, schema: str, malformed: str = "raise") -> DataFrame:
    """JSON lines; blank lines are skipped. ``report`` keeps malformed lines in _corrupt_record."""
    if malformed == "report":
        schema += ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", MODES[malformed]).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_report(summary: DataFrame, path: str) -> None:
    """One JSON object from a frame of one row."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def merge_report(spark: SparkSession, old: str | None, key: str, summary: DataFrame) -> DataFrame:
    """A progress report of one row and column, ``report``: the JSON object at ``old`` (none, or one that
    can't be read, is empty) with the summary under ``key``."""
    new = summary.select(F.struct(*summary.columns).alias("s")).limit(1).select(F.to_json(F.struct(F.col("s").alias(key))).alias("new"))
    text = spark.read.option("wholetext", True).text(old).agg(F.max("value").alias("old")) if old else spark.range(1).select(F.lit(None).cast("string").alias("old"))
    entries = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    kept = F.filter(entries(F.col("old")), lambda k: k != key)
    of = F.from_json("old", "map<string, variant>")
    parts = F.transform(kept, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(of[k])))
    inner = F.regexp_extract("new", r"(?s)^\{(.*)\}$", 1)
    both = text.crossJoin(F.broadcast(new))  # one row each
    return both.select(F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(inner)), ","), F.lit("}")).alias("report"))


#: Suffixes of plain texts; others need a reader of their own.
TEXT_SUFFIXES = ("txt", "md", "rst")


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """file_name, suffix, text of every file. Texts are decoded; ``readers`` maps further suffixes to
    functions of a column of bytes, such as pandas UDFs. Files of other suffixes have a null text."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file_name"), "content")
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    text = F.when(suffix.isin(*TEXT_SUFFIXES), F.decode("content", "UTF-8"))
    for name, reader in (readers or {}).items():
        text = text.when(suffix == name, reader(F.col("content")))
    return rows.select("file_name", suffix.alias("suffix"), text.alias("text"))


def read_json_dir(spark: SparkSession, path: str, glob: str, schema: str, limit: int) -> DataFrame:
    """file_name and the object of each of the last ``limit`` names, which come first; the rest isn't opened.
    The fields of a file that holds no object are null."""
    rows = read_folder(spark, path, glob, limit).select("file_name", F.from_json("text", schema).alias("o"))
    return rows.select("file_name", "o.*").orderBy(F.desc("file_name"))


#: Characters that XML can't hold.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


@F.pandas_udf(BinaryType())
def encode_docx(texts: pd.Series) -> pd.Series:
    """A .docx file of each text: a paragraph for each line. Characters that XML can't hold are left out."""
    def one(text: str | None):
        if text is None:
            return None
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for x in NOT_XML.sub("", text).split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            entry = zipfile.ZipInfo("word/document.xml", (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(entry, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()

    return texts.map(one)


@F.pandas_udf(VECTOR)
def decode_vectors(blobs: pd.Series) -> pd.Series:
    """float32 little-endian bytes, or JSON as text; null if neither gives finite numbers."""
    def one(blob: bytes | None):
        if blob is None:
            return None
        if len(blob) and len(blob) % 4 == 0:
            v = np.frombuffer(blob, "<f4")
            if np.isfinite(v).all():
                return v
        try:
            v = np.array(json.loads(blob.decode()), np.float32)
        except (ValueError, UnicodeDecodeError):
            return None
        return v if v.ndim == 1 and np.isfinite(v).all() else None

    return blobs.map(one)


@F.pandas_udf(BinaryType())
def encode_vectors(vectors: pd.Series) -> pd.Series:
    """float32 little-endian bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def embedder(model) -> Column:
    """Pandas UDF of an injected model: ``model()`` is built once a worker and maps texts to vectors."""

    @F.pandas_udf(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = model()
        for texts in batches:
            yield pd.Series(list(ready(texts.fillna("").tolist())))

    return embed


def hashed_vectors(texts: list[str], size: int = 8) -> list[np.ndarray]:
    """Stand-in model: unit vectors from digests of the texts."""
    out = []
    for text in texts:
        v = np.frombuffer(hashlib.sha256(text.encode()).digest()[:size], np.uint8) / 255 * 2 - 1
        out.append((v / np.linalg.norm(v)).astype(np.float32))
    return out
