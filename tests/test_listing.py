"""Folders of many files are listed and read by tasks, with the rows of Spark's readers."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tests.test_files import RDF, ebook
from tomewright.plans import pipelines
from tomewright.sources import files as src
from tomewright.sources import listing, metadata

NAMES = {
    "a b.txt": b"x\n", "p%q.txt": b"\xff\xfe a\x00b", "h#x?.txt": b"\xef\xbb\xbfabc", "ü [1]{2}.txt": b"a\r\nb\r\n", "empty.txt": b"", "_hidden.txt": b"1",
    "_k=v.txt": b"12", ".dot": b"1", "x._COPYING_": b"1", "_metadata": b"1", "_h/f.txt": b"1", "_x=1/f.txt": b"1", "sub/deep/er/f.txt": b"123456", "z.gz": gzip.compress(b"zipped"),
    "name=1/f.txt": b"1", "name=2/f.txt": b"22", "name=3/in/f.txt": b"3", "name=4": b"file",
}


@pytest.fixture()
def odd(tmp_path):
    for name, content in NAMES.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "in/sub", tmp_path / "in/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "in/broken")
    return str(tmp_path / "in")


SCANS = {
    "books": lambda spark, top: src.book_files(spark, top).withColumn("content", F.hex(F.col("content").cast("binary"))),
    "small": lambda spark, top: src.book_files(spark, top, smaller_than=2),
    "flat": lambda spark, top: src.book_files(spark, top + "/name=*", recursive=False),
    "several": lambda spark, top: src.book_files(spark, [top + "/sub", top + "/na?e=2"]),
    "every": lambda spark, top: src.book_files(spark, top + "/*"),
    "charset": src.book_files_by_charset,
    "small by charset": lambda spark, top: src.book_files_by_charset(spark, top, smaller_than=3),
    "count": src.count_files,
    "count of a pattern": lambda spark, top: src.count_files(spark, top + "/name=*"),
}


@pytest.mark.parametrize("scan", SCANS)
def test_tasks_find_the_files_that_sparks_readers_find(spark, odd, monkeypatch, scan):
    wanted = SCANS[scan](spark, odd)
    monkeypatch.setattr(listing, "DRIVER_LISTS", 5)
    found = SCANS[scan](spark, odd)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.dtypes == wanted.dtypes
    # The driver has listed nothing.
    assert not found.inputFiles()


def test_what_tasks_cannot_list_is_left_to_spark(spark, odd, monkeypatch):
    monkeypatch.setattr(listing, "DRIVER_LISTS", 0)
    assert src.book_files(spark, odd + "/sub/deep/er/f.txt").count() == 1
    assert src.book_files(spark, odd + "/*/*.txt").count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.book_files(spark, odd + "/nowhere")


def test_records_of_many_files(spark, tmp_path, monkeypatch):
    whole = RDF.format(ebook(1, "Whales", "Sea &amp; land", born="1850") + "<!-- c -->" + ebook(2))
    cases = {
        "two": whole, "self": RDF.format('<pgterms:ebook rdf:about="ebooks/7"/>' + ebook(8, "x")), "deep": f"<a><b>{ebook(4, 'y')}</b></a>", "none": RDF.format(""),
        "comment": RDF.format(f"<!-- {ebook(5)} -->" + ebook(6, "<![CDATA[a<b>&]]>")), "inside": RDF.format(ebook(14, ebook(15, "in"))), "late": whole + " <",
        "entity": RDF.format(ebook(24, "a &bad; b") + ebook(25, "fine")), "garbage": "not xml", "a [b]*{c}": whole[:-30], "open": RDF.format(ebook(9, "a").replace("</rdf:value>", "")),
        "latin": whole.replace("utf-8", "latin-1"), "roots": ebook(33, "a") + ebook(34, "b"), "mark": "﻿" + whole, "blank": " \n",
    }
    cases |= {f"cut{i}": whole[:i] for i in range(1, len(whole), 9)}
    for name, text in cases.items():
        (tmp_path / f"{name}.rdf").write_text(text, encoding="utf-8")
    (tmp_path / "z.rdf.gz").write_bytes(gzip.compress(whole.encode()))
    wanted = metadata.metadata_files(spark, str(tmp_path))
    monkeypatch.setattr(listing, "DRIVER_LISTS", 20)
    found = metadata.metadata_files(spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.dtypes == wanted.dtypes
    # Well-formed files are cut by tasks; the others are read a few at a time.
    assert len(metadata.ebooks_in(whole.encode())) == 2 and metadata.ebooks_in(whole[:-30].encode()) is None


def test_stored_folders_of_many_files(spark, tmp_path, monkeypatch):
    for i in range(12):
        for top, text in (("rdf", RDF.format(ebook(i, "Whales"))), ("books", f"Title: {i}\n\ncafé")):
            path = tmp_path / top / str(i % 2) / f"{i}" / "f.txt"
            path.parent.mkdir(parents=True)
            path.write_text(text)
    monkeypatch.setattr(listing, "DRIVER_LISTS", 2)
    listed = []
    plain = listing.files_in_tasks
    for module in (src, metadata):
        monkeypatch.setattr(module, "files_in_tasks", lambda *a, **b: listed.append(found := plain(*a, **b)) or found)
    folders = [[str(tmp_path / top / part) for part in "01"] for top in ("rdf", "books")]
    assert pipelines.stored_metadata(spark, folders[0], str(tmp_path / "records")).count() == 12
    assert pipelines.stored_books(spark, folders[1], str(tmp_path / "stored")).where("content like 'Title%café'").count() == 12
    assert pipelines.book_metadata(spark, str(tmp_path / "rdf"), str(tmp_path / "all")).select("ebook_id").distinct().count() == 12
    assert src.count_files_by_folder(spark, folders[0]) == 12
    assert len(listed) == 7 and all(found is not None for found in listed)
