"""Tables as matrices: header keys, projection to an ordered subset of columns, and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans import rules as R


def cells(text: Column | str) -> Column:
    """Matrix of a table block: rows by line, cells by a bar."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(text, "\n", -1), lambda row: F.transform(F.split(row, r"\|", -1), lambda cell: F.trim(cell)))


def header_keys(matrix: Column) -> Column:
    """Keys of the header row, or null unless the table is simple: two rows or more, all of one width, and header keys
    that are neither empty nor repeated."""
    keys = F.transform(matrix[0], T.neutral)
    simple = (F.size(matrix) >= 2) & F.forall(matrix, lambda r: F.size(r) == F.size(matrix[0])) & F.forall(keys, lambda k: k != "") & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(simple, keys)


def projection(target_keys: Column, source_keys: Column) -> Column:
    """Places (from 0) of the target's keys in the source's, if they are a strict subset in order; empty if both are the
    same; null otherwise."""
    places = F.transform(target_keys, lambda k: F.array_position(source_keys, k).cast("int") - 1)
    ordered = F.forall(F.sequence(F.lit(0), F.size(places) - 1), lambda i: (F.get(places, i) >= 0) & ((i == 0) | (F.get(places, i) > F.coalesce(F.get(places, i - 1), F.lit(-1)))))
    return F.when(target_keys == source_keys, F.array().cast("array<int>")).when(ordered & (F.size(target_keys) < F.size(source_keys)), places)


def projected(matrix: Column, places: Column) -> Column:
    """The matrix's columns at ``places``, in that order."""
    return F.transform(matrix, lambda row: F.transform(places, lambda i: F.get(row, i)))


def mixed(target_text, source_text) -> Column:
    """Whether a target table holds analysis of its own that the source table lacks."""
    own = "|".join(R.TARGET_TABLE_WORDS)
    return F.col(target_text).rlike(own) & ~F.col(source_text).rlike(own)


def lost_labels(target: Column, source: Column) -> Column:
    """Keys of the target's row labels that no row of the source has."""
    keys = lambda m: F.filter(F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda r: T.row_key(r[0])), lambda k: k != "")
    return F.array_except(keys(target), keys(source))


def trailing_heading(target_text: str, source_text: str) -> Column:
    """A heading at the end of a target paragraph that the source lacks, or null."""
    tail = F.regexp_extract(F.col(target_text), R.TRAILING_HEADING, 1)
    return F.when((tail != "") & (T.neutral(tail) != "") & ~F.contains(T.neutral(source_text), T.neutral(tail)), tail)


def column_widths(widths: Column, total: Column) -> Column:
    """Widths scaled to ``total``, whole numbers, the remainder with the last column."""
    every = F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)
    scaled = F.transform(widths, lambda w: F.floor(w * total / every).cast("long"))
    rest = total - F.aggregate(scaled, F.lit(0).cast("long"), lambda a, w: a + w)
    return F.transform(scaled, lambda w, i: w + F.when(i == F.size(scaled) - 1, rest).otherwise(0))
