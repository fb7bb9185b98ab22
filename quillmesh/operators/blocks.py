"""Ordered blocks: splitting, body range, heading paths, scopes and runs, all as windows over (document, index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans import rules as R

LEVELS = range(10)


def split_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, index, kind, text`` of every line of a text; empty lines stay, as they hold a place."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("index", "text")).select(
        "doc", "index", F.lit("paragraph").alias("kind"), "text"
    )


def in_order(*more: str):
    return Window.partitionBy("doc", *more).orderBy("index")


def content_bounds(blocks: DataFrame) -> DataFrame:
    """``doc, lo, hi``: the body runs from the opening phrase to the closing phrase or the seal page."""
    opens = F.min(F.when(F.contains("text", F.lit(R.BODY_STARTS)), F.col("index")))
    bounds = blocks.groupBy("doc").agg(F.coalesce(opens + 1, F.lit(1)).alias("lo"), F.count("*").alias("n"))
    text = F.trim("text")
    closing = blocks.where(text.startswith(R.BODY_ENDS) | F.contains(text, F.lit(R.SEAL))).select("doc", F.col("index").alias("at"))
    ends = bounds.join(closing, "doc").where("at >= lo").groupBy("doc").agg(F.min("at").alias("at"))
    return bounds.join(ends, "doc", "left").select("doc", "lo", F.coalesce("at", F.col("n").cast("int")).alias("hi"))


def body(blocks: DataFrame) -> DataFrame:
    return blocks.join(content_bounds(blocks), "doc").where("index >= lo AND index < hi").drop("lo", "hi")


def _stacked(blocks: DataFrame) -> tuple[DataFrame, Column]:
    """``blocks`` with the last heading of each level so far, and the array of those that are open: (at, title).

    The last heading of each level is open if it stands after the last ones of all lower levels. Lines of a table of
    contents have none and open nothing.
    """
    so_far = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("heading") & ~F.col("is_toc")
    last = [F.last(F.when(opens & (F.col("level") == n), F.struct(F.col("index").alias("at"), F.col("text").alias("title"))), ignorenulls=True).over(so_far).alias(f"h{n}_") for n in LEVELS]

    def below(n: int) -> Column:
        return F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"h{k}_.at"), F.lit(-1)) for k in range(n)))

    now = F.array_compact(F.array(*(F.when(F.col(f"h{n}_.at") > below(n), F.col(f"h{n}_")) for n in LEVELS)))
    return blocks.select("*", *last), F.when(~F.col("is_toc"), now).otherwise(F.slice(now, 1, 0))


def heading_path(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with ``heading, level, is_toc``) and ``path``: the open headings' texts, the own one last."""
    stacked, now = _stacked(blocks)
    return stacked.withColumn("path", F.transform(now, lambda h: h["title"])).drop(*(f"h{n}_" for n in LEVELS))


def open_headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``path`` and ``open``: texts and places of the open headings, the own one last."""
    stacked, now = _stacked(blocks)
    return stacked.withColumn("path", F.transform(now, lambda h: h["title"])).withColumn("open", F.transform(now, lambda h: h["at"])).drop(*(f"h{n}_" for n in LEVELS))


def scope_end(blocks: DataFrame) -> DataFrame:
    """``blocks`` and ``scope_end``: where the next heading of the same or a lower level, or a contents line, stands."""
    after = in_order().rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("doc")
    stops = [F.first(F.when(F.col("is_toc") | F.col("heading") & (F.col("level") <= n), F.col("index")), ignorenulls=True).over(after) for n in LEVELS]
    level = F.coalesce("level", F.lit(LEVELS[-1]))
    ended = F.coalesce(F.element_at(F.array(*stops), level + 1), F.max("index").over(whole) + 1)
    return blocks.withColumn("scope_end", F.when(F.col("heading"), ended))


def section_state(blocks: DataFrame, marker: Column, by: list[str]) -> DataFrame:
    """``blocks`` and ``section``: the last marker at or above a block within ``by``, else ``other``."""
    window = Window.partitionBy(*by).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.coalesce(F.last(marker, ignorenulls=True).over(window), F.lit("other")))


def islands(rows: DataFrame, by: list[str], index: str, other: str | None = None) -> DataFrame:
    """``rows`` and ``island``: runs of neighbouring ``index``, on one diagonal with ``other`` where that is given."""
    window = Window.partitionBy(*by).orderBy(index)
    breaks = F.col(index) - F.lag(index).over(window) != 1
    if other:
        breaks = breaks | (F.col(other) - F.lag(other).over(window) != 1)
    return rows.withColumn("break_", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("island", F.sum("break_").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("break_")


def nearest_marked(rows: DataFrame, by: list[str], index: str, marked: Column, value: Column) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the value of the nearest marked row on either side, without the own."""
    window = Window.partitionBy(*by).orderBy(index)
    found = F.when(marked, value)
    return rows.withColumn("before", F.last(found, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(found, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    )


def sentence_windows(blocks: DataFrame, most: int = 3, least_chars: int = 25) -> DataFrame:
    """``doc, index, first, size, text`` of each run of one to ``most`` neighbouring sentences that is long enough."""
    from quillmesh.functions.similarity import sentence_boundaries

    cut = blocks.select("doc", "index", "text", sentence_boundaries("text").alias("ends"))
    begin = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    single = cut.select("doc", "index", "text", "ends", F.posexplode("ends").alias("first", "end_")).withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(most))))
    stop = F.get("ends", F.col("first") + F.col("size") - 1)
    windows = single.where(F.col("first") + F.col("size") <= F.size("ends")).select("doc", "index", "first", "size", F.substring("text", begin(F.col("first")) + 1, stop - begin(F.col("first"))).alias("text"))
    return windows.where(F.length("text") >= least_chars)


def with_forms(blocks: DataFrame) -> DataFrame:
    """``blocks`` and the forms that matching needs."""
    return blocks.withColumn("n", T.neutral("text")).withColumn("structural", T.structural_heading("text"))
