"""Coverage recovery to its fixed point: blocks that their accepted neighbours place, round after round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans.store import drop_table, written

#: Fixed value: headings that tell of the inspection and not of the subject.
ABOUT_INSPECTION = "核查(?:情况|记录|程序|结论)"
_PAIR = ("doc", "index", "source_doc", "source_index")


def literal(c) -> Column:
    return F.regexp_replace(c, r"[ \t-\r]+", "")


def _subjects(outline: DataFrame) -> DataFrame:
    """Body blocks with ``form`` and the keys of the two innermost headings that name a subject."""
    keys = F.transform(F.filter("path", lambda p: ~F.rlike(p, F.lit(ABOUT_INSPECTION))), lambda p: T.title_key(p))
    return outline.where("NOT heading AND NOT is_toc").select("doc", "index", literal("text").alias("form"), keys.alias("k")).where("form != ''").select("doc", "index", "form", F.get("k", F.size("k") - 1).alias("k1"), F.get("k", F.size("k") - 2).alias("k2"))


def recover_coverage(targets: DataFrame, sources: DataFrame, accepted: DataFrame, *, eligible: Column | None = None, least_key: int = 4, bridge_key: int = 8, bridge_chars: int = 20) -> DataFrame:
    """``doc, index, source_doc, source_index, round``: the ``accepted`` pairs (round 0) and those that they lead to.

    ``targets`` and ``sources`` are outlines of blocks, as of ``scopes.outlined``. In each round, an open target block
    that is ``eligible`` takes the source block with the same text and subject that stands right after, or before, the
    source of an accepted neighbour; or, after a heading that both have alike, the one that follows the source of an
    accepted, identical paragraph of ``bridge_chars`` characters before that heading. If the round offers several, the
    block stays open for good. Accepted pairs lead on in the next round.

    A round joins the pairs of the last one alone with the blocks beside them, never all blocks of one text, so its
    work follows what it finds. There are as many rounds as the longest stretch recovered from one side has blocks.
    """
    t = written(_subjects(targets if eligible is None else targets.where(eligible)), "open-blocks")
    s = written(_subjects(sources).select(*(F.col(c).alias(f"s_{c}" if c in ("form", "k1", "k2") else f"source_{c}") for c in ("doc", "index", "form", "k1", "k2"))), "source-blocks")
    heading = lambda df, doc, index, x: df.where("heading AND NOT is_toc").select(F.col("doc").alias(doc), (F.col("index") - 1).alias(index), literal("text").alias(f"{x}_title"), F.col("level").alias(f"{x}_level"), T.title_key("text").alias(f"{x}_key"))
    alike = "t_title = s_title AND t_level = s_level"
    t_heads, s_heads = heading(targets, "doc", "index", "t"), heading(sources, "source_doc", "source_index", "s")
    form = lambda df, doc, index, x: df.where("NOT heading").select(F.col("doc").alias(doc), F.col("index").alias(index), literal("text").alias(x))

    whole = (F.col("form") == F.col("s_form")) & (F.length("form") >= bridge_chars)
    start = accepted.select(*_PAIR).distinct().join(form(targets, "doc", "index", "form"), ["doc", "index"], "left").join(form(sources, "source_doc", "source_index", "s_form"), ["source_doc", "source_index"], "left")
    found = written(start.select(*_PAIR, F.coalesce(whole, F.lit(False)).alias("whole"), F.lit(0).alias("round"), F.lit(True).alias("taken")), "round-0")
    every = found
    number = 0
    while found.where("taken").head(1):
        number += 1
        last = found.where("taken")
        step = F.explode(F.array(F.lit(-1), F.lit(1))).alias("d")
        beside = last.select(*_PAIR, step).select("doc", (F.col("index") + F.col("d")).alias("index"), "source_doc", (F.col("source_index") + F.col("d")).alias("source_index"))
        over = last.where("whole").join(t_heads, ["doc", "index"]).join(s_heads, ["source_doc", "source_index"]).where(f"{alike} AND length(t_key) >= {bridge_key}")
        over = over.select("doc", (F.col("index") + 2).alias("index"), "source_doc", (F.col("source_index") + 2).alias("source_index"))
        same_subject = (F.col("k1") == F.col("s_k1")) & ((F.length("k1") >= least_key) | ((F.col("k2") == F.col("s_k2")) & (F.length("k2") >= least_key)))
        met = beside.union(over).distinct().join(t, ["doc", "index"]).join(s, ["source_doc", "source_index"]).where((F.col("form") == F.col("s_form")) & same_subject)
        met = met.join(every.select("doc", "index").distinct(), ["doc", "index"], "left_anti")
        one = met.groupBy("doc", "index").agg(F.count("*").alias("n"), F.min(F.struct("source_doc", "source_index", (F.length("form") >= bridge_chars).alias("whole"))).alias("s"))
        found = written(one.select("doc", "index", "s.source_doc", "s.source_index", "s.whole", F.lit(number).alias("round"), (F.col("n") == 1).alias("taken")), f"round-{number}")
        # one table of all rounds, so that a plan doesn't grow with their number
        after = written(every.unionByName(found), "rounds")
        if number > 1:
            drop_table(every)
        every = after
    return every.where("taken").select(*_PAIR, "round")
