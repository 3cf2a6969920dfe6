"""Folders as a data source: what is opened, readers by suffix, and files that are written again."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, folder

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_paragraphs_then_tables():
    row = f"<w:tr><w:tc>{p('a')}</w:tc><w:tc>{p(' ')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr>"
    body = p("one") + p(" ") + f"<w:tbl>{row}<w:tr><w:tc>{p('')}</w:tc></w:tr></w:tbl>" + "<w:p><w:r><w:t>t</w:t><w:tab/><w:t>wo</w:t><w:br/><w:t>x</w:t></w:r></w:p>"
    assert folder.docx_text(docx(body)) == "one\nt\two\nx\na | b\nc"
    assert folder.docx_text(docx("")) == ""
    assert folder.docx_text(b"no archive") is None and folder.docx_text(b"") is None


def test_plain_text_by_encoding():
    assert [folder.plain_text(x) for x in ("软件工程师".encode(), "软件工程师".encode("gbk"), b"caf\xe9\xff", b"")] == ["软件工程师", "软件工程师", "caf\xe9\xff", ""]


@pytest.fixture
def some(tmp_path):
    for name, data in (("a.txt", "x"), ("b.MD", ""), ("c.pdf", "z"), ("d.bin", "w"), ("none", "w"), (".hidden.txt", "w"), ("_open.txt", "w"), ("bad.docx", "w")):
        (tmp_path / name).write_text(data)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "e.txt").write_text("deep")
    return f"file://{tmp_path}"


def test_reads_by_suffix(spark, some):
    got = {r.file_name: (r.suffix, r.size, r.text) for r in folder.read_folder(spark, some, readers={"pdf": lambda data: "pdf " + data.decode()}).collect()}
    assert got == {"a.txt": ("txt", 1, "x"), "b.MD": ("md", 0, ""), "c.pdf": ("pdf", 1, "pdf z"), "d.bin": ("bin", 1, None), "none": ("", 1, None), "bad.docx": ("docx", 1, None)}
    assert folder.read_folder(spark, some, "*.none").count() == 0


def test_names_choose_files_before_they_are_opened(spark, some, tmp_path):
    read = lambda *how: folder.read_folder(spark, some, *how, readers={"pdf": lambda data: str(1 / 0)})
    with pytest.raises(Exception, match="division by zero"):
        read().collect()
    assert sorted(r.file_name for r in read("a*|*.bin").collect()) == ["a.txt", "d.bin"]
    assert [r.file_name for r in folder.read_folder(spark, some, "*.*", 2).collect()] == ["d.bin", "c.pdf"]
    # a limit comes before filters, and a frame that is filtered stays whole
    assert folder.read_folder(spark, some, "*.*", 2).where("file_name = 'a.txt'").count() == 0
    rows = folder.read_folder(spark, some)
    assert [rows.where("file_name = 'a.txt'").count(), rows.count()] == [1, 6]


def test_shares_are_bounded(tmp_path, monkeypatch):
    for k in range(10):
        (tmp_path / f"{k}.txt").write_text("abc")
    of = lambda **options: folder.FolderReader({"path": f"file://{tmp_path}", **options}, folder.READERS)
    monkeypatch.setattr(folder, "SHARE_FILES", 4)
    assert [len(s.files) for s in of().partitions()] == [4, 4, 2]
    monkeypatch.setattr(folder, "SHARE_BYTES", 6)
    assert [len(s.files) for s in of().partitions()] == [2] * 5
    assert sum(len(s.files) for s in of(limit="3").partitions()) == 3
    assert [s.files for s in of(glob="x*").partitions()] == [[]]


def test_a_write_that_runs_again_replaces_its_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(f"f{k}.txt", b"v%d" % k) for k in range(50)] + [("null.txt", None)], "file_name string, content binary")
    for _ in range(2):
        folder.write_folder(rows, path)
    assert sorted(os.listdir(tmp_path / "out")) == sorted([f"f{k}.txt" for k in range(50)] + ["null.txt"])
    assert {r.file_name: r.text for r in folder.read_folder(spark, path).collect()} == {**{f"f{k}.txt": f"v{k}" for k in range(50)}, "null.txt": ""}
    with pytest.raises(Exception, match="no name of a file"):
        folder.write_folder(spark.createDataFrame([("a/b", b"")], "file_name string, content binary"), path)


def test_docx_round_trip(spark):
    texts = ["one\ntwo", "", None, "a < b & c\r\n\x01ü 职", "  kept  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", files.encode_docx("text").alias("b")).collect()
    got = {r.id: r.b and folder.docx_text(bytes(r.b)) for r in rows}
    assert got == {0: "one\ntwo", 1: "", 2: None, 3: "a < b & c\r\nü 职", 4: "  kept  "}


def test_json_objects_last_names_first(spark, tmp_path):
    for k, text in enumerate(['{"id": 1}', "oops", '{"id": 3, "x": "y"}', '{"id": 4}']):
        (tmp_path / f"jd_{k}.json").write_text(text)
    (tmp_path / "other.json").write_text('{"id": 9}')
    got = files.read_json_dir(spark, f"file://{tmp_path}", "jd_*.json", "id int, x string", 3).collect()
    assert [tuple(r) for r in got] == [("jd_3.json", 4, None), ("jd_2.json", 3, "y"), ("jd_1.json", None, None)]
