"""Folders of many small files as a Python data source: read in shares, by suffix, and written as one file a row."""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Files and bytes of a share, which one task reads.
SHARE_FILES, SHARE_BYTES = 250, 64 << 20
#: Bytes after which a task gives out a batch.
BATCH_BYTES = 4 << 20
SCHEMA = "file_name string, suffix string, size bigint, text string"
ARROW = pa.schema([("file_name", pa.string()), ("suffix", pa.string()), ("size", pa.int64()), ("text", pa.string())])
#: Encodings of plain texts, tried in this order.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin1")
#: Fixed value: namespace of the elements of a .docx file.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python are bounded by bytes from here on, as long texts would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def plain_text(data: bytes) -> str:
    """By the first encoding that fits; line ends are as written."""
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode(ENCODINGS[-1])


def _said(element: ElementTree.Element) -> str:
    """Text of a paragraph or cell, with its tabs and breaks."""
    out = []
    for e in element.iter():
        if e.tag == WORD + "t":
            out.append(e.text or "")
        elif e.tag == WORD + "tab":
            out.append("\t")
        elif e.tag in (WORD + "br", WORD + "cr"):
            out.append("\n")
    return "".join(out)


def _cell(cell: ElementTree.Element) -> str:
    return "\n".join(_said(p) for p in cell.iter(WORD + "p")).strip()


def docx_text(data: bytes) -> str | None:
    """Paragraphs that aren't blank, then the rows of tables with their filled cells; null if it is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(WORD + "body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    if body is None:
        return ""
    lines = [_said(p) for p in body.findall(WORD + "p")]
    for row in (r for t in body.findall(WORD + "tbl") for r in t.findall(WORD + "tr")):
        lines.append(" | ".join(filter(None, map(_cell, row.findall(WORD + "tc")))))
    return "\n".join(x for x in lines if x.strip())


#: Readers by suffix; a file of another suffix has a null text.
READERS: dict[str, Callable[[bytes], str | None]] = {"txt": plain_text, "md": plain_text, "rst": plain_text, "json": plain_text, "docx": docx_text}


def suffix_of(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


@dataclass
class Share(InputPartition):
    """Files of one task: paths and sizes."""

    files: list[tuple[str, int]]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict, readers: dict[str, Callable[[bytes], str | None]]):
        self.path, self.readers = options["path"], readers
        self.globs = options.get("glob", "*").split("|")
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[Share]:
        """Names and sizes alone are listed here; shares are bounded by files and bytes."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = [(i.base_name, i.path, i.size) for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
        found = [x for x in found if x[0][0] not in "._" and any(fnmatch.fnmatchcase(x[0], g) for g in self.globs)]
        found.sort(reverse=self.limit is not None)
        shares, files, held = [], [], 0
        for _, path, size in found if self.limit is None else found[: self.limit]:
            if files and (len(files) >= SHARE_FILES or held + size > SHARE_BYTES):
                shares.append(Share(files))
                files, held = [], 0
            files.append((path, size))
            held += size
        return [*shares, Share(files)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, size in share.files:
            name = path.rpartition("/")[2]
            reader = self.readers.get(suffix_of(name))
            text = None
            if reader:  # others aren't opened
                with system.open_input_stream(path, compression=None) as stream:
                    text = reader(stream.read())
            rows.append({"file_name": name, "suffix": suffix_of(name), "size": size, "text": text})
            held += max(size, len(text or ""))  # a .docx is packed
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceArrowWriter):
    """A file for each row of (file_name, content). A file appears whole, under its own name, so that a task
    that runs again replaces what it wrote; what a failed job finished stays."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        n = 0
        for batch in iterator:
            for name, content in zip(batch.column("file_name").to_pylist(), batch.column("content").to_pylist()):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no name of a file: {name!r}")
                open_ = f"{root}/_{uuid.uuid4().hex}"
                with system.open_output_stream(open_, compression=None) as stream:
                    stream.write(content or b"")
                system.move(open_, f"{root}/{name}")
                n += 1
        return Written(n)


def source_of(format_: str, readers: dict[str, Callable[[bytes], str | None]]) -> type[DataSource]:
    class Folder(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> FolderReader:
            return FolderReader(dict(self.options), readers)

        def writer(self, schema, overwrite: bool) -> FolderWriter:
            return FolderWriter(dict(self.options))

    return Folder


def register(spark: SparkSession, readers: dict[str, Callable[[bytes], str | None]] | None = None) -> str:
    """Name of the format that reads folders, made known to the session: ``file_folder``, or one of its own for
    further ``readers`` by suffix, as Spark looks a format up again when it plans."""
    name = f"file_folder_{uuid.uuid4().hex}" if readers else "file_folder"
    spark.dataSource.register(source_of(name, {**READERS, **(readers or {})}))
    return name


def read_folder(spark: SparkSession, path: str, glob: str = "*", limit: int | None = None, readers: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """file_name, suffix, size, text of the files of a folder (not of those below it) whose names fit ``glob``,
    or one of several, divided by |.

    ``limit`` takes the last names only; no other file is opened. Both are options and not filters that Spark
    pushes down, as a Python source keeps what was pushed when its frame is scanned again. ``path`` is a URI of a file system that
    pyarrow knows. Names that begin with a dot or an underscore are left out; a folder without files gives
    no rows; an empty file has an empty text, one that its reader can't read or of an unknown suffix a null one.
    """
    reader = spark.read.format(register(spark, readers)).option("glob", glob)
    return (reader if limit is None else reader.option("limit", limit)).load(path)


def write_folder(df: DataFrame, path: str) -> None:
    """A file for each row of ``df``: its ``file_name`` and ``content`` (null: empty). Names are unique."""
    small_batches(df.sparkSession)
    df.select("file_name", "content").write.format(register(df.sparkSession)).mode("append").save(path)
