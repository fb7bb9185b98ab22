"""Quotation marks that stay open across blocks, as a prefix scan of an associative element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that nest, each with the one that closes it.
PAIRS = {"“": "”", "「": "」", "『": "』"}
_NONE = "array<string>"


def _closed(state: Column, marks: Column) -> Column:
    """A state (``want``: closing marks that found nothing open, ``open``: closing marks that are awaited) after more
    closing marks: one that is awaited last closes, another one is nothing, and with nothing open it is wanted."""
    last = lambda s: F.get(s["open"], F.size(s["open"]) - 1)
    shorter = lambda s: F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
    step = lambda s, c: (
        F.when(F.size(s["open"]) == 0, F.struct(F.concat(s["want"], F.array(c)).alias("want"), s["open"].alias("open")))
        .when(last(s) == c, F.struct(s["want"].alias("want"), shorter(s).alias("open")))
        .otherwise(s)
    )
    return F.aggregate(marks, state, step)


def _after(a: Column, b: Column) -> Column:
    """The element of a stretch and the next one: the second's wanted marks meet what the first leaves open."""
    met = _closed(a, b["want"])
    return F.struct(met["want"].alias("want"), F.concat(met["open"], b["open"]).alias("open"))


def _empty() -> Column:
    return F.struct(F.array().cast(_NONE).alias("want"), F.array().cast(_NONE).alias("open"))


def _element(text: Column, pairs: dict[str, str]) -> Column:
    """The element of one text, mark by mark."""
    marks = "".join(pairs) + "".join(pairs.values())
    escaped = "".join(f"\\{m}" if m in "[]()^-\\{}" else m for m in marks)
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{escaped}]+", "")
    closer = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    single = lambda c: F.when(closer[c].isNotNull(), F.struct(F.array().cast(_NONE).alias("want"), F.array(closer[c]).alias("open"))).otherwise(F.struct(F.array(c).alias("want"), F.array().cast(_NONE).alias("open")))
    return F.when(kept == "", _empty()).otherwise(F.aggregate(F.filter(F.split(kept, ""), lambda c: c != ""), _empty(), lambda a, c: _after(a, single(c))))


def quote_state(blocks: DataFrame, pairs: dict[str, str] | None = None, stretch: int = 256) -> DataFrame:
    """``blocks`` (``doc, index, text``) with ``depth``, the marks open after a block, and ``quoted``: whether any is
    open before or after it.

    A mark closes only the one opened last; others are nothing. Blocks are folded in stretches of ``stretch``, then the
    stretches of a document in order, and each stretch again from where it begins, so no task holds more of a document
    than one stretch, or one element for each of its stretches. A null text has no marks.
    """
    pairs = PAIRS if pairs is None else pairs
    element = blocks.select("doc", "index", F.floor(F.col("index") / stretch).alias("stretch"), _element(F.col("text"), pairs).alias("e"))
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "e"))), lambda x: x["e"])
    folded = element.groupBy("doc", "stretch").agg(in_order("index").alias("es")).select("doc", "stretch", F.aggregate("es", _empty(), _after).alias("e"))
    # states before each stretch: a list that grows by the state after the one before
    grown = lambda states, e: F.concat(states, F.array(_after(F.element_at(states, -1), e)))
    ordered = folded.groupBy("doc").agg(F.array_sort(F.collect_list("stretch")).alias("stretches"), in_order("stretch").alias("es"))
    begins = ordered.select("doc", F.explode(F.arrays_zip("stretches", F.aggregate("es", F.array(_empty()), grown).alias("states"))).alias("z")).where("z.stretches IS NOT NULL").select("doc", F.col("z.stretches").alias("stretch"), F.col("z.states").alias("before"))
    cells = element.groupBy("doc", "stretch").agg(F.array_sort(F.collect_list("index")).alias("indices"), in_order("index").alias("es")).join(begins, ["doc", "stretch"])
    states = cells.select("doc", F.explode(F.arrays_zip("indices", F.aggregate("es", F.array("before"), grown).alias("states"), F.slice(F.aggregate("es", F.array("before"), grown), 2, stretch).alias("after"))).alias("z")).where("z.indices IS NOT NULL")
    depth = lambda c: F.size(F.col(c))
    marked = states.select("doc", F.col("z.indices").alias("index"), depth("z.after.open").cast("long").alias("depth"), ((depth("z.states.open") > 0) | (depth("z.after.open") > 0)).alias("quoted"))
    return blocks.join(marked, ["doc", "index"])
