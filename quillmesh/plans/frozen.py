"""Frozen plans: a digest of each row in one canonical form, and of a whole table, that a sink checks before it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = (1, 16, 31, 46)  # where the parts of a row's digest begin that are added up, 15 hexadecimal digits each


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON without blanks, its keys in code-point order and nulls written out."""
    names = sorted(df.columns if columns is None else columns)
    return F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)), {"ignoreNullFields": "false"})


def row_digests(df: DataFrame, columns: list[str] | None = None, name: str = "digest") -> DataFrame:
    return df.withColumn(name, F.sha2(canonical_json(df, columns), 256))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``n, digest`` of a table, one row: the order of rows and partitions doesn't matter, their number does.

    Parts of the rows' digests are added up in whole numbers, which each task does for its own rows; repeated rows
    count as often as they occur.
    """
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("d_", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    sums = row_digests(df, columns, "d_").agg(F.count("*").alias("n"), *(part(at).alias(f"s{at}_") for at in _LANES))
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"s{at}_").cast("string") for at in _LANES)), 256).alias("digest"))


class PlanChanged(ValueError):
    """The rows aren't those that were frozen."""


def write_frozen(df: DataFrame, path: str, digest: str, columns: list[str] | None = None) -> None:
    """Write the table that ``digest`` was taken of, or refuse: a changed, missing, added or repeated row raises
    :class:`PlanChanged`, and nothing is written."""
    found = table_digest(df, columns).first()
    if found["digest"] != digest:
        raise PlanChanged(f"{found['n']} rows with digest {found['digest']}, not {digest}")
    df.write.parquet(path)
