"""Uploaded material: nested ZIP archives to files, roles, one source and its targets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds of an archive; what passes them is an error, never a part of a result."""

    depth: int = 4
    entries: int = 30_000
    total: int = 600 << 20
    file: int = 180 << 20
    ratio: int = 500


def decoded_name(info: zipfile.ZipInfo) -> str:
    """An entry's name; names without the UTF-8 flag are read as UTF-8 or else GB 18030."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for encoding in ("utf-8", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return info.filename


def unpacked(name: str, data: bytes, limits: Limits = Limits(), depth: int = 0, used: list[int] | None = None) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of every DOCX in a file or in archives inside it. Lock files and folders are passed over."""
    used = used if used is not None else [0, 0]
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    if base.startswith("~$"):
        return
    if base.lower().endswith(".docx"):
        if len(data) > limits.file:
            raise ValueError(f"{base} is too large")
        yield base, data
    elif base.lower().endswith(".zip"):
        if depth >= limits.depth:
            raise ValueError("archives are nested too deeply")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                inner = decoded_name(info).replace("\\", "/")
                if inner.endswith("/"):
                    continue
                if inner.startswith("/") or ".." in inner.split("/"):
                    raise ValueError(f"{inner} leaves the archive")
                used[0] += 1
                used[1] += info.file_size
                if used[0] > limits.entries or used[1] > limits.total or info.file_size > limits.file or info.file_size > limits.ratio * max(1, info.compress_size):
                    raise ValueError("the archive passes a limit")
                yield from unpacked(inner, z.read(info), limits, depth + 1, used)


def scan_uploads(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``seq, part, name, content`` of all DOCX files in rows ``seq, name, content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seq, name, data in zip(frame["seq"], frame["name"], frame["content"]):
                for k, (inner, body) in enumerate(unpacked(name, bytes(data), limits)):
                    yield pd.DataFrame([(seq, k, inner, body)], columns=["seq", "part", "name", "content"])

    return uploads.select("seq", "name", "content").mapInPandas(run, "seq long, part int, name string, content binary")


def first_copies(files: DataFrame) -> DataFrame:
    """One row for each content, the first to arrive, with ``doc`` (its digest) and ``n_copies``."""
    first = F.min(F.struct("seq", "part"))
    hashed = files.withColumn("doc", F.sha2("content", 256))
    firsts = hashed.groupBy("doc").agg(first.alias("f"), F.count("*").alias("n_copies")).select("doc", "n_copies", F.col("f.seq").alias("seq"), F.col("f.part").alias("part"))
    return hashed.join(firsts, ["doc", "seq", "part"])


def is_source(name: Column, head: Column) -> Column:
    """Whether a file is the authoritative one: by its name, or by a cover line of its own among its first lines.

    ``head`` holds the first non-empty lines. A mention in the body decides nothing.
    """
    named = F.contains(name, F.lit("募集说明书")) & ~F.contains(name, F.lit("说明性文件"))
    cover = F.exists(F.slice(head, 1, 8), lambda line: (F.length(F.trim(line)) <= 20) & F.trim(line).endswith("募集说明书"))
    other = F.exists(F.slice(head, 1, 8), lambda line: (F.length(F.trim(line)) <= 60) & F.contains(line, F.lit("说明性文件")))
    return named | cover & ~other & ~F.contains(name, F.lit("说明性文件"))


def with_roles(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """``files`` (with ``doc, name``) and ``role``: source or target. Fails unless there is exactly one source."""
    lines = blocks.where((F.col("index") < 12) & (F.trim("text") != "")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]).alias("head"))
    marked = files.join(lines, "doc", "left").withColumn("is_source", is_source(F.col("name"), F.coalesce("head", F.array().cast("array<string>"))))
    n = marked.where("is_source").count()
    if n != 1:
        raise ValueError(f"expected one source, found {n}")
    return marked.withColumn("role", F.when(F.col("is_source"), "source").otherwise("target")).drop("head", "is_source")


def recommended(files: DataFrame) -> DataFrame:
    """The best target of each issuer and chapter: originals first, then pending ones, then those without history."""
    yes = lambda c, n: F.when(F.col(c), n).otherwise(0)
    score = yes("original", 100) + yes("pending", 30) - yes("revised", 40) + F.when(F.col("revisions") == 0, 15).otherwise(0)
    order = Window.partitionBy("issuer", "chapter").orderBy(F.desc("score"), "seq")
    return files.withColumn("score", score).withColumn("r_", F.row_number().over(order)).where("r_ = 1").drop("r_")
