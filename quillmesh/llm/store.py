"""Shared storage: the library's written tables, and Arrow file systems for files of other kinds."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame

from quillmesh.plans.store import drop_table, new_path, shared_dir, written

__all__ = ["arrow_fs", "aside", "drop_table", "fresh", "new_path", "shared_dir", "written"]


def arrow_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a URI (file, hdfs, s3, gs) or a plain local path."""
    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``df`` doesn't have yet, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name += "_"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that are named like one of ``own`` under other names, and the way from old to new names."""
    names = {o.lower() for o in own}
    clash = [c for c in df.columns if c.lower() in names]
    moved = dict(zip(clash, fresh(df, *(f"{c}_of_input" for c in clash)), strict=True))
    return df.withColumnsRenamed(moved), moved
