"""One batch from files to files: archives or packages in, changed packages, a report and a ZIP out.

    python -m quillmesh.batch OUT FILE... [--author NAME] [--decisions FILE.json]
"""

from __future__ import annotations

import argparse
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import safe_name
from quillmesh.operators import resolve
from quillmesh.plans.analyze import analyze
from quillmesh.plans.store import written
from quillmesh.sources import docx, uploads


def prepared(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with roles, the blocks of all of them, and the packages that can't be read, with the reason."""
    read = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("name"), "content")
    numbered = read.withColumn("seq", F.array_position(F.array(*(F.lit(Path(p).name) for p in paths)), F.element_at(F.split("name", "/"), -1)))
    files = written(uploads.first_copies(uploads.scan_uploads(numbered)), "files")
    blocks = written(docx.scan_packages(files), "blocks")
    damaged = blocks.where("kind = 'error'")
    sound, blocks = files.join(damaged.select("doc"), "doc", "left_anti"), blocks.where("kind != 'error'")
    return written(uploads.with_roles(sound, blocks), "roles"), blocks, damaged.select("doc", "name", "error")


def proposals_of(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Proposals for all targets of one source."""
    of = lambda role: blocks.join(files.where(F.col("role") == role).select("doc"), "doc", "left_semi").select("doc", "index", "kind", "text", "is_toc", "drawing", "cells")
    return written(analyze(of("source").drop("doc"), of("target").drop("cells")), "proposals")


def zipped(folder: Path, target: Path) -> None:
    """All files of a folder, sorted, in one ZIP."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(p for p in folder.rglob("*") if p.is_file()):
            z.write(path, path.relative_to(folder).as_posix())


def run(spark: SparkSession, out: str, paths: list[str], author: str = "editor", date: str = "1970-01-01T00:00:00Z", decisions: dict | None = None) -> dict:
    """Analyse and export; returns the report that is also written as JSON. Packages go to the driver one at a time."""
    files, blocks, damaged = prepared(spark, paths)
    proposals = proposals_of(files, blocks)
    wishes = [(k, v, None) if isinstance(v, str) else (k, v.get("decision"), v.get("source_index")) for k, v in (decisions or {}).items()]
    sources = blocks.join(files.where("role = 'source'").select("doc"), "doc", "left_semi")
    decided = written(resolve.decided(proposals, spark.createDataFrame(wishes, "id string, decision string, source_index int"), sources), "decided")
    changed = decided.where("decision = 'update' AND text != new_text")  # what reads the same is not written again
    saved = docx.export(files.where("role = 'target'").withColumn("name", safe_name("name")), changed, author, date)
    folder = Path(out) / "documents"
    folder.mkdir(parents=True, exist_ok=True)
    report = {
        "documents": [{"doc": r.doc, "name": r.name, "operations": 0, "error": r.error} for r in damaged.collect()],
        "summary": resolve.summary(proposals, []).first().asDict(),
        "unchanged": decided.where("decision = 'update' AND text = new_text").count(),
        "blocked": [r.id for r in decided.where("decision = 'blocked'").select("id").orderBy("id").toLocalIterator()],
    }
    for row in saved.toLocalIterator():
        if row.content is not None:
            (folder / f"{row.doc[:8]}-{row.name}").write_bytes(bytes(row.content))
        report["documents"].append({"doc": row.doc, "name": row.name, "operations": row.n_operations, "error": row.error})
    (Path(out) / "report.json").write_text(json.dumps(report, ensure_ascii=False, indent=1))
    zipped(folder, Path(out) / "documents.zip")
    return report


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("out")
    parser.add_argument("files", nargs="+")
    parser.add_argument("--author", default="editor")
    parser.add_argument("--decisions")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    chosen = json.loads(Path(args.decisions).read_text()) if args.decisions else None
    print(json.dumps(run(spark, args.out, args.files, args.author, decisions=chosen)["summary"]))


if __name__ == "__main__":
    main()
