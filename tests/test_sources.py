"""Packages, archives and roles, on files built here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmesh.sources import docx, uploads

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, extra=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{props}<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>{extra}</w:p>'


def sheet(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def package(*body, styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


OLD_INS = '<w:ins w:id="1"><w:r><w:t> new</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText> old</w:delText></w:r></w:del>'
STYLES = '<w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style>'


def test_scan(spark):
    data = package(paragraph("Title"), paragraph("Head", "K"), paragraph("a &amp; b", extra=OLD_INS), sheet(["x", "y"], ["1", "2"]), paragraph("Part\t9", "TOC1"), styles=STYLES)
    rows = docx.scan_packages(spark.createDataFrame([("f.docx", data)], "name string, content binary")).orderBy("index").collect()
    assert [r.text for r in rows] == ["Title", "Head", "a & b new", "x | y\n1 | 2", "Part\t9"]
    assert [r.kind for r in rows] == ["paragraph"] * 3 + ["table", "paragraph"]
    assert rows[1].outline == 1 and rows[0].outline is None and rows[4].is_toc and rows[0].revisions == 2
    assert [[c.text for c in row] for row in rows[3].cells] == [["x", "y"], ["1", "2"]]
    for bad in (b"", b"junk", archive(a__txt=b"x")):
        with pytest.raises(ValueError):
            docx.scan(bad, "f")


def test_changes_can_be_accepted_and_rejected(spark):
    data = package(paragraph("one"), paragraph("two"), sheet(["h", "v"], ["a", "1"]), paragraph("end"))
    doc = docx.scan(data, "f")[0]["doc"]
    files = spark.createDataFrame([("f.docx", data), ("g.docx", package(paragraph("alone")))], "name string, content binary")
    ops = [(doc, 1, "paragraph", "two", "zwei & <drei>", "update"), (doc, 2, "table", "h | v\na | 1", "h | v\na | 2\nb | 3", "update"), (doc, 0, "paragraph", "one", "eins", "keep")]
    proposals = spark.createDataFrame(ops, "doc string, index int, kind string, text string, new_text string, decision string")
    out = {r.name: r for r in docx.export(files, proposals).collect()}
    f = out["f.docx"]
    assert f.error == "" and f.n_operations == 2
    assert docx.resolved(bytes(f.content), True) == ["one", "zwei & <drei>", "h | v\na | 2\nb | 3", "end"]
    assert docx.resolved(bytes(f.content), False) == ["one", "two", "h | v\na | 1", "end"]
    assert out["g.docx"].n_operations == 0 and docx.resolved(bytes(out["g.docx"].content), True) == ["alone"]
    stale = docx.export(files, proposals.withColumn("text", F.lit("other"))).where("name = 'f.docx'").first()
    assert stale.content is None and "changed" in stale.error
    assert docx.write_document(data, [{"index": 2, "kind": "paragraph", "old_text": "h | v\na | 1", "new_text": "x"}], "a", "d")[0] is None


def test_uploads(spark):
    source = package(paragraph("2021年公司债券募集说明书"), paragraph("body"))
    target = package(paragraph("关于本次发行的说明性文件"), paragraph("依据募集说明书"))
    nested = archive(inner__zip=archive(t__docx=target), **{"~$t__docx": b"x", "t2__docx": target})
    rows = [(0, "a.docx", source), (1, "b.zip", nested), (2, "notes.txt", b"x")]
    found = uploads.scan_uploads(spark.createDataFrame(rows, "seq long, name string, content binary"))
    assert found.count() == 3
    once = uploads.first_copies(found)
    assert sorted((r.name, r.n_copies) for r in once.collect()) == [("a.docx", 1), ("t.docx", 2)]
    roles = uploads.with_roles(once, docx.scan_packages(once))
    assert {r.name: r.role for r in roles.collect()} == {"a.docx": "source", "t.docx": "target"}
    twice = spark.createDataFrame([(0, "a.docx", source), (1, "募集说明书.docx", package(paragraph("x")))], "seq long, name string, content binary")
    both = uploads.first_copies(uploads.scan_uploads(twice))
    with pytest.raises(Exception, match="expected one source, found 2"):
        uploads.with_roles(both, docx.scan_packages(both)).collect()


def test_archive_limits():
    deep = b""
    for _ in range(6):
        deep = archive(x__zip=deep or archive(a__txt=b"1"))
    with pytest.raises(ValueError, match="deeply"):
        list(uploads.unpacked("d.zip", deep))
    with pytest.raises(ValueError, match="leaves"):
        list(uploads.unpacked("d.zip", archive(**{"../a__docx": b"1"})))
    with pytest.raises(ValueError, match="limit"):
        list(uploads.unpacked("d.zip", archive(a__docx=b"1", b__docx=b"2"), uploads.Limits(entries=1)))
    info = zipfile.ZipInfo("说明.docx".encode("gb18030").decode("cp437"))
    info.flag_bits = 0
    assert uploads.decoded_name(info) == "说明.docx"


def test_recommended(spark):
    rows = [(1, "i", "c", True, False, False, 0), (2, "i", "c", True, True, False, 0), (3, "i", "c", True, True, True, 0), (4, "i", "d", False, False, False, 1)]
    frame = spark.createDataFrame(rows, "seq long, issuer string, chapter string, original boolean, pending boolean, revised boolean, revisions int")
    assert sorted((r.chapter, r.seq, r.score) for r in uploads.recommended(frame).collect()) == [("c", 2, 145), ("d", 4, 0)]


def test_damaged_packages_are_rows(spark):
    good = package(paragraph("Title"))
    rows = docx.scan_packages(spark.createDataFrame([("a.docx", good), ("b.docx", b"junk"), ("c.docx", None)], "name string, content binary")).collect()
    assert sorted((r.name, r.kind, r["index"], r.error) for r in rows) == [("a.docx", "paragraph", 0, None), ("b.docx", "error", -1, "not a ZIP package"), ("c.docx", "error", -1, "not a ZIP package")]


def test_cells_of_several_paragraphs(spark):
    data = package(paragraph("one"), sheet(["h", "v"], ["a", "1"]))
    cells = [["h", "v"], ["b1\nb2", "2 | 3"]]
    saved, error = docx.write_document(data, [{"index": 1, "kind": "table", "old_text": "h | v\na | 1", "new_text": "", "cells": cells}], "a", "1970-01-01T00:00:00Z")
    assert error == ""
    assert [[c["text"] if isinstance(c, dict) else c[0] for c in row] for row in docx.scan(saved, "f")[1]["cells"]] == cells
    assert docx.resolved(saved, False) == docx.resolved(data, True)
