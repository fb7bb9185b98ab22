"""Passes over proposals after the ordered step: unit lines, structural gaps, clauses, reviews, the voice sweep.

Proposals are rows ``doc, index, kind, text, n, status, source_index, score, candidates``; sources are the blocks of one
authoritative document with ``index, kind, text, n, structural``. The order of the passes is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.similarity import grams, lcs_ratio
from quillmesh.operators import tables
from quillmesh.operators.blocks import in_order
from quillmesh.plans import rules as R
from quillmesh.plans.rules import THRESHOLDS, Thresholds


def updated(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``found`` (keyed by doc and index) where it has them."""
    named = found.select("doc", "index", F.lit(True).alias("hit_"), *(F.col(c).alias(f"{c}_") for c in columns))
    joined = rows.join(named, ["doc", "index"], "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("hit_"), F.col(f"{c}_")).otherwise(F.col(c)))
    return joined.drop("hit_", *(f"{c}_" for c in columns))


def bind_unit_lines(proposals: DataFrame, blocks: DataFrame, sources: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """A unit line takes its source from the table that follows: the unit line right above that table's source.

    With no such line, one that reads differently, or a table that isn't settled, it goes to review.
    """
    following = proposals.select("doc", (F.col("index") - 1).alias("index"), F.col("status").alias("table_status"), F.col("source_index").alias("table_source"))
    tables = blocks.where("kind = 'table'").select("doc", (F.col("index") - 1).alias("index"))
    units = proposals.where((F.col("kind") == "paragraph") & F.col("text").rlike(R.UNIT_LINE)).join(tables, ["doc", "index"]).join(following, ["doc", "index"])
    above = sources.select(F.col("index").alias("at"), F.col("kind").alias("s_kind"), F.col("text").alias("s_text"), F.col("n").alias("s_n"), F.col("structural").alias("s_structural"))
    near = units.where("table_status = 'ready' AND table_source IS NOT NULL").withColumn("back", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.col("table_source") - F.col("back")).join(above, "at")
    stop = (F.col("s_kind") == "table") | F.col("s_structural")
    is_unit = F.col("s_text").rlike(R.UNIT_LINE) & ~stop
    first = F.min_by(F.struct("at", "s_n", is_unit.alias("ok")), "back")
    # One empty line may stand between the table and its unit line.
    seen = near.where(stop | is_unit | (F.trim("s_text") != "")).groupBy("doc", "index", "n").agg(first.alias("u")).where("u.ok")
    bound = seen.withColumn("score", lcs_ratio("n", F.col("u.s_n"))).where(F.col("score") >= t.unit_ratio).select("doc", "index", F.col("u.at").alias("source_index"), "score")
    result = units.select("doc", "index").join(bound, ["doc", "index"], "left").withColumn("status", F.when(F.col("source_index").isNotNull(), "ready").otherwise("review")).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return updated(proposals, result, ["status", "source_index", "score"])


def _ready() -> Column:
    return (F.col("status") == "ready") & F.col("source_index").isNotNull()


def anchored(proposals: DataFrame) -> DataFrame:
    """``proposals`` and ``before``, ``after``: (target index, source index) of the nearest settled ones."""
    pair = F.when(_ready(), F.struct(F.col("index").alias("t"), F.col("source_index").alias("s")))
    return proposals.withColumn("before", F.last(pair, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(pair, ignorenulls=True).over(in_order().rowsBetween(1, Window.unboundedFollowing))
    )


def resolve_gaps(proposals: DataFrame, blocks: DataFrame, sources: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Settles the first open body of a gap between two anchors whose sides are equally long and shaped.

    Kinds and structural headings must agree place by place, heading pairs have equal numbering, and there is one pair
    at least. A body that is settled becomes an anchor for those behind it, so a gap's later bodies need a pair of
    headings of their own after it.
    """
    open_rows = anchored(proposals).where("status = 'review' AND kind = 'paragraph' AND before IS NOT NULL AND after IS NOT NULL")
    spans = open_rows.where((F.col("before.s") < F.col("after.s")) & (F.col("after.t") - F.col("before.t") == F.col("after.s") - F.col("before.s")) & (F.col("after.t") - F.col("before.t") <= t.gap_blocks))
    spans = spans.select("doc", "index", F.col("before.t").alias("t0"), F.col("before.s").alias("s0"), F.col("after.t").alias("t1"))
    places = spans.withColumn("at", F.explode(F.sequence(F.col("t0") + 1, F.col("t1") - 1))).withColumn("source_at", F.col("s0") + F.col("at") - F.col("t0"))
    mine = blocks.select("doc", F.col("index").alias("at"), F.col("kind").alias("k"), F.col("structural").alias("h"), T.lead_token("text").alias("lead"))
    theirs = sources.select(F.col("index").alias("source_at"), F.col("kind").alias("sk"), F.col("structural").alias("sh"), T.lead_token("text").alias("s_lead"))
    pairs = places.join(mine, ["doc", "at"], "left").join(theirs, "source_at", "left")
    agree = F.coalesce((F.col("k") == F.col("sk")) & (F.col("h") == F.col("sh")) & (~F.col("h") | (F.col("lead") != "") & (F.col("lead") == F.col("s_lead"))), F.lit(False))
    own = F.col("at") == F.col("index")
    judged = pairs.groupBy("doc", "index", "t0", "t1").agg(
        F.bool_and(agree).alias("ok"),
        F.array_sort(F.collect_list(F.when(F.col("h"), F.col("at")))).alias("headings"),
        F.max(F.when(own, F.col("source_at"))).alias("source_index"),
        F.bool_or(own & (F.col("h") | (F.col("sk") != "paragraph"))).alias("shaped"),
    )
    # Bodies of a gap in order: each needs a heading pair between the one settled before it and the gap's end.
    able = judged.where("ok AND NOT shaped AND size(headings) > 0")
    gap = Window.partitionBy("doc", "t0", "t1").orderBy("index")
    last_heading = F.element_at("headings", -1)
    settled = able.withColumn("earlier", F.lag("index").over(gap)).where(F.col("earlier").isNull() | (F.col("earlier") < last_heading)).select("doc", "index", "source_index", F.lit("ready").alias("status"), F.lit(1.0).alias("score"))
    return updated(proposals, settled, ["status", "source_index", "score"])


def resolve_clauses(proposals: DataFrame, sources: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Settles a sentence that is one clause of a source paragraph shortly before the next anchor's source.

    Adds ``segment``. Two equally good clauses with different wording settle nothing.
    """
    proposals = proposals if "segment" in proposals.columns else proposals.withColumn("segment", F.lit(None).cast("string"))
    rows = anchored(proposals).where("status = 'review' AND kind = 'paragraph' AND after IS NOT NULL").withColumn("key", T.segment_key("text")).where(F.length("key") >= t.clause_chars)
    near = rows.select("doc", "index", "key", F.explode(F.sequence(F.greatest(F.lit(0), F.col("after.s") - t.clause_window), F.greatest(F.lit(0), F.col("after.s") - 1))).alias("source_index"))
    parts = sources.where("kind = 'paragraph' AND NOT structural").select(F.col("index").alias("source_index"), F.explode(T.clauses("text")).alias("segment")).withColumn("s_key", T.segment_key("segment")).where(F.length("s_key") >= t.clause_chars)
    long, short = F.greatest(F.length("key"), F.length("s_key")), F.least(F.length("key"), F.length("s_key"))
    pairs = near.join(parts, "source_index").withColumn("size", long / short).where(F.col("size") <= t.clause_length).withColumn("score", lcs_ratio("key", "s_key")).where(F.col("score") >= t.clause_ratio)
    order = Window.partitionBy("doc", "index").orderBy(F.desc("score"), "size", F.desc("source_index"), "s_key")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("next_", F.lead(F.struct("score", "s_key")).over(order)).where("rank = 1")
    close = F.coalesce((F.col("score") - F.col("next_.score") < t.clause_margin) & (F.col("s_key") != F.col("next_.s_key")), F.lit(False))
    found = ranked.where(~close).select("doc", "index", "source_index", "segment", F.lit("ready").alias("status"), F.round("score", 4).alias("score"))
    return updated(proposals, found, ["status", "source_index", "score", "segment"])


def settle_reviews(proposals: DataFrame, sources: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Keeps a review open where a candidate can replace the whole block, with those candidates; the rest is retained."""
    forms = sources.select(F.col("index").alias("s_index"), F.col("kind").alias("s_kind"), F.col("n").alias("s_n"))
    reviews = proposals.where("status = 'review' AND kind = 'paragraph'").select("doc", "index", "n", F.explode("candidates").alias("c")).withColumn("s_index", F.col("c.source_index"))
    pairs = reviews.join(forms, "s_index").where((F.col("s_kind") == "paragraph") & (F.length("n") >= t.action_chars) & (F.length("s_n") >= t.action_chars) & (F.length("s_n") >= t.action_length * F.length("n")) & (F.col("c.score") >= t.action_score))
    pairs = pairs.withColumn("own", grams("n")).withColumn("theirs", grams("s_n"))
    whole = pairs.where(F.size(F.array_intersect("own", "theirs")) >= t.action_coverage * F.size("own"))
    able = whole.groupBy("doc", "index").agg(F.collect_set("s_index").alias("able"))
    joined = proposals.join(able, ["doc", "index"], "left")
    review = F.col("status") == "review"
    kept = F.filter("candidates", lambda c: F.array_contains("able", c["source_index"]))
    return (
        joined.withColumn("review_required", review & F.col("able").isNotNull())
        .withColumn("candidates", F.when(review & F.col("able").isNotNull(), kept).when(review, F.slice("candidates", 1, 0)).otherwise(F.col("candidates")))
        .withColumn("status", F.when(review & F.col("able").isNull(), "retained").otherwise(F.col("status")))
        .drop("able")
    )


def voice_sweep(blocks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Body blocks without a proposal whose own voice would change: ``doc, index, kind, text, n``, status ``wording``."""
    rest = blocks.where(F.trim("text") != "").join(proposals.select("doc", "index"), ["doc", "index"], "left_anti")
    return rest.where(T.adapt("text") != F.col("text")).select("doc", "index", "kind", "text", "n", F.lit("wording").alias("status"), F.lit(1.0).alias("score"))


def decided(proposals: DataFrame, decisions: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``proposals`` with ``decision``: a user's one by id, else update for what is settled; retained rows stay kept.

    A review is updated only with a source that is one of its candidates. With ``sources`` (``index, kind, text``) it
    then gets that source's whole text, a table its matrix, too, in ``new_text`` and ``new_cells``: the scanned matrix
    where ``sources`` have one (``cells``, of structs with ``text``), as cells may hold lines and bars of their own.
    """
    chosen = decisions.select("id", F.col("decision").alias("wish"), F.col("source_index").alias("picked"))
    joined = proposals.join(chosen, "id", "left")
    allowed = F.coalesce(F.exists("candidates", lambda c: c["source_index"] == F.col("picked")), F.lit(False))
    default = F.when(F.col("status").isin("ready", "wording"), "update").otherwise("keep")
    decision = F.when(F.col("status") == "retained", "keep").when((F.col("status") == "review") & (F.col("wish") == "update"), F.when(allowed, "update").otherwise("blocked")).otherwise(F.coalesce("wish", default))
    by_hand = (F.col("status") == "review") & (F.col("decision") == "update")
    out = joined.withColumn("decision", decision).withColumn("source_index", F.when(by_hand, F.col("picked")).otherwise(F.col("source_index")))
    if sources is not None:
        matrix = tables.cells("text")
        if "cells" in sources.columns:
            matrix = F.coalesce(F.transform("cells", lambda row: F.transform(row, lambda cell: cell["text"])), matrix)
        texts = sources.select(F.col("index").alias("picked"), F.col("text").alias("p_text"), F.when(F.col("kind") == "table", matrix).alias("p_cells"))
        out = out.join(texts, "picked", "left").withColumn("new_text", F.when(by_hand, T.adapt_for("p_text", F.col("text"))).otherwise(F.col("new_text")))
        adapted = F.transform("p_cells", lambda row: F.transform(row, lambda cell: T.adapt(cell)))
        out = out.withColumn("new_cells", F.when(by_hand, adapted).otherwise(F.col("new_cells"))).drop("p_text", "p_cells")
    return out.drop("wish", "picked")


def summary(proposals: DataFrame, by: list[str]) -> DataFrame:
    """Counts of proposals by status, for each ``by`` or for all."""
    n = lambda s: F.count_if(F.col("status") == s)
    return proposals.groupBy(*by).agg(
        F.count_if(F.col("status").isin("ready", "wording")).alias("changes"), n("ready").alias("source_updates"), n("wording").alias("wording_updates"), n("review").alias("review"), n("retained").alias("retained")
    )
