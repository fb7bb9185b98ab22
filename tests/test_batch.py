"""From files to files."""

import zipfile

from quillmesh import batch
from quillmesh.sources import docx
from tests.test_sources import archive, package, paragraph

FACT = "截至报告期末，发行人注册资本为人民币{}万元，法定代表人为张三，住所位于某市某区某路一百号，主要从事城市基础设施建设业务。"


def test_batch(spark, tmp_path):
    source = package(paragraph("甲公司公司债券募集说明书"), paragraph("第一章 发行人情况"), paragraph(FACT.format("12,000")))
    target = package(paragraph("关于本次发行的说明性文件"), paragraph("说明如下："), paragraph(FACT.format("10,000").replace("发行人", "公司")), paragraph("特此说明。"))
    (tmp_path / "source.docx").write_bytes(source)
    (tmp_path / "targets.zip").write_bytes(archive(**{"t__docx": target, "u__docx": target}))
    report = batch.run(spark, str(tmp_path / "out"), [str(tmp_path / "source.docx"), str(tmp_path / "targets.zip")])
    assert report["summary"]["source_updates"] == 1 and [d["error"] for d in report["documents"]] == [""]
    with zipfile.ZipFile(tmp_path / "out" / "documents.zip") as z:
        (name,) = z.namelist()
        data = z.read(name)
    assert docx.resolved(data, False) == docx.resolved(target, True)
    assert docx.resolved(data, True)[2] == FACT.format("12,000").replace("发行人", "公司")
