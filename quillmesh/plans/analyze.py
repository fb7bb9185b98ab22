"""The whole analysis: one authoritative document's blocks against the blocks of many targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import blocks as B
from quillmesh.operators import context, match, resolve, tables
from quillmesh.plans.rules import THRESHOLDS, Thresholds
from quillmesh.plans.store import written


def analyze(sources: DataFrame, targets: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Proposals of every target's body: ``id, doc, index, kind, text, status, source_index, score, segment,
    table_projection, same_visible, review_required, candidates, mode, new_text, new_cells``.

    ``sources`` has ``index, kind, text``, ``targets`` also ``doc``; both may have ``is_toc`` and ``drawing``, sources
    also ``cells`` as of the scan. ``mode`` tells where ``new_text`` is from: ``summary`` keeps the target's own wording
    of a longer source, ``clause`` is one clause of it, ``columns`` a table's columns that the target has, ``body`` the
    source before a heading that the target's paragraph ends with, ``copy`` the whole source, ``wording`` the target in
    the issuer's voice. ``new_cells`` is a table's new matrix.
    """
    for flag in ("is_toc", "drawing"):
        sources = sources if flag in sources.columns else sources.withColumn(flag, F.lit(False))
        targets = targets if flag in targets.columns else targets.withColumn(flag, F.lit(False))
    sources, every = written(B.with_forms(sources), "sources"), written(B.with_forms(targets), "targets")
    if "cells" not in sources.columns:
        sources = sources.withColumn("cells", F.lit(None).cast("array<array<struct<text:string>>>"))
    inside = written(B.body(every), "bodies")
    figures = sources.where("drawing").agg(F.collect_list(F.col("index").cast("int")).alias("figure_"))
    worded = inside.where(F.trim("text") != "")
    found = written(match.candidates(worded, sources.where("NOT is_toc"), t), "candidates")

    both = found.join(worded.select("doc", "index", "kind", "text").where("kind = 'table'"), ["doc", "index"]).join(sources.select(F.col("index").alias("source_index"), F.col("text").alias("s_text")), "source_index")
    keys = both.withColumn("tk", tables.header_keys(tables.cells("text"))).withColumn("sk", tables.header_keys(tables.cells("s_text")))
    shaped = keys.withColumn("places", tables.projection(F.col("tk"), F.col("sk")))
    misfit = F.col("tk").isNotNull() & F.col("sk").isNotNull() & (F.col("tk") != F.col("sk")) & F.col("places").isNull()
    shaped = shaped.withColumn("refused", tables.mixed("text", "s_text") | F.coalesce(misfit, F.lit(False)))
    blocked = shaped.where("refused").groupBy("doc", "index").agg(F.collect_list(F.col("source_index").cast("int")).alias("blocked"))
    places = shaped.where("size(places) > 0").select("doc", "index", F.col("source_index"), F.col("places").alias("table_projection"))

    rows = (
        inside.where((F.trim("text") != "") | F.col("drawing"))
        .join(context.gathered(found), ["doc", "index"], "left")
        .join(blocked, ["doc", "index"], "left")
        .join(figures)
        .select(
            "doc", "index", "kind", "structural", F.length("n").alias("n_chars"), "candidates", "blocked",
            F.when((F.trim("text") == "") & F.col("drawing"), F.col("figure_")).alias("figure"),
            (T.adapt("text") != F.col("text")).alias("wording"),
        )
    )
    # Every pass reads the proposals more than once, so each is written before the next.
    judged = context.folded(rows, t).join(inside.select("doc", "index", "kind", "text", "n"), ["doc", "index"])
    judged = written(judged, "judged")

    unsettled = judged.where("status != 'ready' AND kind = 'paragraph'").join(inside.select("doc", "index", "structural"), ["doc", "index"]).where("NOT structural")
    whole = match.contained(unsettled, sources.where("NOT is_toc"), t).select("doc", "index", "source_index", "score", F.lit(None).cast("string").alias("segment"))
    left = unsettled.join(whole.select("doc", "index"), ["doc", "index"], "left_anti")
    part = match.drifted(left, sources.where("NOT is_toc"), t).select("doc", "index", "source_index", "score", "segment")
    kinds = lambda found, mode: found.withColumn("mode", F.lit(mode)).withColumn("status", F.lit("ready"))
    projected = kinds(whole, "summary").unionByName(kinds(part, "clause"))
    judged = judged.withColumn("segment", F.lit(None).cast("string")).withColumn("mode", F.lit(None).cast("string"))
    judged = written(resolve.updated(judged, written(projected, "projected"), ["status", "source_index", "score", "segment", "mode"]), "projections")
    judged = written(resolve.bind_unit_lines(judged, every, sources, t), "unit-lines")
    judged = written(resolve.resolve_gaps(judged, every, sources, t), "gaps")
    judged = written(resolve.resolve_clauses(judged, sources, t), "clauses")
    judged = written(resolve.settle_reviews(judged, sources, t), "reviews")
    swept = resolve.voice_sweep(inside, judged)
    proposals = judged.unionByName(swept, allowMissingColumns=True).join(places, ["doc", "index", "source_index"], "left")
    matrix = F.coalesce(F.transform("cells", lambda row: F.transform(row, lambda cell: cell["text"])), tables.cells("text"))
    texts = sources.select(F.col("index").alias("source_index"), F.col("text").alias("s_text"), F.when(F.col("kind") == "table", matrix).alias("s_cells"))
    proposals = with_content(proposals.join(texts, "source_index", "left"))
    return proposals.select(
        T.stable_id(F.col("doc").cast("string"), F.col("index"), F.coalesce("source_index", F.lit(-1)), F.col("text")).alias("id"),
        "doc", "index", "kind", "text", "status", "source_index", F.round("score", 4).alias("score"), "segment", "table_projection",
        F.coalesce((F.col("status") == "ready") & T.visible_equal("new_text", "text"), F.lit(False)).alias("same_visible"),
        F.coalesce("review_required", F.lit(False)).alias("review_required"),
        "candidates", "mode", "new_text", "new_cells",
    )


def with_content(proposals: DataFrame) -> DataFrame:
    """``proposals`` (with ``s_text`` and, for tables, ``s_cells`` of their source) and ``mode, new_text, new_cells``."""
    ready = F.col("status") == "ready"
    tail = F.when(F.col("kind") == "paragraph", tables.trailing_heading("text", "s_text"))
    columns = (F.col("kind") == "table") & (F.size("table_projection") > 0)
    mode = (
        F.when(F.col("status") == "wording", "wording")
        .when(ready & F.col("mode").isNotNull(), F.col("mode"))
        .when(ready & F.col("segment").isNotNull(), "clause")
        .when(ready & columns, "columns")
        .when(ready & tail.isNotNull(), "body")
        .when(ready, "copy")
    )
    told = proposals.withColumn("mode", mode).withColumn("tail_", tail)
    cells = F.when(F.col("mode") == "columns", tables.projected(F.col("s_cells"), F.col("table_projection"))).when(
        (F.col("mode") == "copy") & (F.col("kind") == "table"), F.transform("s_cells", lambda row: F.transform(row, lambda cell: T.adapt(cell)))
    )
    told = told.withColumn("new_cells", cells)
    spaced = F.contains("s_text", F.lit(" | "))
    lines = F.transform("new_cells", lambda row: F.when(spaced, F.array_join(row, " | ")).otherwise(F.array_join(row, "|")))
    text = (
        F.when(F.col("mode").isin("wording", "summary"), T.adapt("text"))
        .when(F.col("mode") == "clause", T.adapt_for("segment", F.col("text")))
        .when(F.col("mode") == "columns", F.array_join(lines, "\n"))
        .when(F.col("mode") == "body", F.concat(T.adapt_for("s_text", F.col("text")), T.adapt("tail_")))
        .when(F.col("mode") == "copy", T.adapt_for("s_text", F.col("text")))
    )
    return told.withColumn("new_text", text).drop("tail_")
