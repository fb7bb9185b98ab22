"""What single-block matching leaves: merged paragraphs, quoted clauses, table bundles, guards and the final verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import guards
from quillmesh.operators.blocks import in_order
from quillmesh.plans import fact_rules as R


def _joined_text(c: str | Column) -> Column:
    return F.regexp_replace(c, r"[\t-\r \x{3000}]+", "")


def paragraph_merges(targets: DataFrame, sources: DataFrame, reach: int = 5, least: int = 40) -> DataFrame:
    """``doc, index, consumed, source_index``: a target paragraph that the source has merged with a later one.

    Under headings of one key, the source starts with the target's first sentence, and the rest of it is all of the
    later paragraph, with no text in between. Only what is unique counts. Blocks have ``doc, index, text, heading_key``.
    """
    opening = F.regexp_extract("text", f"^(.{{{least},}}?[。；])", 1)
    firsts = targets.withColumn("opening", opening).where((F.col("opening") != "") & (F.length("text") > F.length("opening")) & (F.length("heading_key") >= 4))
    longer = sources.withColumn("opening", opening).where("opening != ''").select("heading_key", "opening", F.col("index").alias("source_index"), F.expr("substring(text, length(opening) + 1)").alias("tail")).where(F.length("tail") >= least)
    pairs = firsts.select("doc", "index", "heading_key", "opening").join(longer, ["heading_key", "opening"]).withColumn("tail", _joined_text("tail"))
    later = targets.select("doc", F.col("index").alias("consumed"), _joined_text("text").alias("tail"))
    hits = pairs.join(later, ["doc", "tail"]).where((F.col("consumed") > F.col("index")) & (F.col("consumed") <= F.col("index") + reach))
    between = targets.where(F.trim("text") != "").select("doc", F.col("index").alias("mid"))
    blocked = hits.join(between, "doc").where("mid > index AND mid < consumed").select("doc", "index", "consumed", "source_index").distinct()
    clear = hits.select("doc", "index", "consumed", "source_index").distinct().join(blocked, ["doc", "index", "consumed", "source_index"], "left_anti")
    return clear.withColumn("n", F.count("*").over(Window.partitionBy("doc", "index"))).where("n = 1").drop("n")


def quoted_clauses(targets: DataFrame, sources: DataFrame, copied: DataFrame, reach: int = 20) -> DataFrame:
    """``doc, index, source_index``: a quoted, numbered lead-in whose whole tail, to the closing quote, is copied.

    ``copied`` (``doc, index, source_index``) are settled copies; the lead-in's text stands in the source without its
    opening quote, and the two blocks or more that follow run side by side in both documents.
    """
    leads = targets.where(F.col("text").rlike(r"^[“「『][0-9]+(?:\.[0-9]+)+.*[：:]$") & (F.length("text") >= 40)).withColumn("close", F.translate(F.substring("text", 1, 1), "“「『", "”」』"))
    keyed = leads.withColumn("key", _joined_text(F.expr("substring(text, 2)"))).select("doc", "index", "close", "key")
    pairs = keyed.join(sources.select(F.col("index").alias("source_index"), _joined_text("text").alias("key")), "key")
    tails = targets.select("doc", F.col("index").alias("at"), F.rtrim("text").alias("t")).join(copied.select("doc", F.col("index").alias("at"), F.col("source_index").alias("from_")), ["doc", "at"], "left")
    steps = pairs.join(tails, "doc").where((F.col("at") > F.col("index")) & (F.col("at") <= F.col("index") + reach)).withColumn("step", F.col("at") - F.col("index"))
    ends = F.min(F.when(F.endswith(F.col("t"), F.col("close")), F.col("step")))
    breaks = F.min(F.when(~F.coalesce(F.col("from_") == F.col("source_index") + F.col("step"), F.lit(False)), F.col("step")))
    closed = steps.groupBy("doc", "index", "source_index").agg(ends.alias("end_"), breaks.alias("break_")).where("end_ >= 2 AND (break_ IS NULL OR break_ > end_)")
    return closed.withColumn("n", F.count("*").over(Window.partitionBy("doc", "index"))).where("n = 1").select("doc", "index", "source_index")


def table_bundles(blocks: DataFrame) -> DataFrame:
    """``doc, index, start, end``: each table with the caption and unit lines right above and the notes right below."""
    caption = F.col("text").rlike(r"^[\t-\r ]*(?:表[0-9一二三四五六七八九十]*[:：\t ]|单位[:：])")
    note = F.col("text").rlike(r"^[\t-\r ]*(?:注[0-9一二三四五六七八九十]*[:：]|数据来源|资料来源)")
    kind = F.when(F.col("kind") == "table", "t").when(caption, "c").when(note, "n").otherwise("x")
    classed = blocks.withColumn("class_", kind)
    above = F.last(F.when(F.col("class_") != "c", F.col("index")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    below = F.first(F.when(F.col("class_") != "n", F.col("index")), ignorenulls=True).over(in_order().rowsBetween(1, Window.unboundedFollowing))
    low, high = F.min("index").over(Window.partitionBy("doc")), F.max("index").over(Window.partitionBy("doc"))
    return classed.select("doc", "index", "class_", F.coalesce(above + 1, low).alias("start"), F.coalesce(below, high + 1).alias("end")).where("class_ = 't'").drop("class_")


def subject_guard(target: str = "t", source: str = "s", with_tables: bool = False) -> Column:
    """Why a source may not replace a target, or an empty string: the first reason that holds.

    Both are structs with ``text`` and ``path`` (array), and, if ``with_tables``, ``lines`` and ``matrices``; the checks
    go from the speaker's scope to the sentence's object and end with what table or paragraph is described. The scope is
    that of the nearest heading that decides.
    """
    scope = lambda side: guards.scope_at(F.col(f"{side}.path"), F.substring(f"{side}.text", 1, 110))
    either = lambda name: (scope(target) == name) != (scope(source) == name)
    if with_tables:
        described = guards.descriptor_veto(F.col(target), F.col(source))
    else:
        described = guards.paragraph_veto(*(guards.paragraph_identity(F.col(f"{side}.text"), F.col(f"{side}.path")) for side in (target, source)))
    t, s = F.col(f"{target}.text"), F.col(f"{source}.text")
    under = lambda side, words: F.exists(F.col(f"{side}.path"), lambda h: h.rlike(words))

    def owner(side: str) -> Column:
        said = F.regexp_extract(F.col(f"{side}.text"), "发行人(?:的)?(" + "|".join(R.CONTROLLERS) + ")", 1)
        roles = F.filter(F.reverse(F.col(f"{side}.path")), lambda h: (F.contains(h, F.lit(R.CONTROLLERS[0])).cast("int") + F.contains(h, F.lit(R.CONTROLLERS[1])).cast("int")) == 1)
        return F.when((said != "") & (F.length(f"{side}.text") < 600), said).otherwise(F.coalesce(F.regexp_extract(F.get(roles, F.lit(0)), "|".join(R.CONTROLLERS), 0), F.lit("")))

    def denied(c: Column) -> Column:
        return F.when(c.rlike(R.DENIALS) & (F.length(c) <= 600), F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in R.DENIED.items())))).otherwise(F.array().cast("array<string>"))

    errors = "会计差错|差错更正"
    unchanged = t.rlike("(?:未|没有).{0,4}(?:变更|变化)") & t.rlike("|".join(R.CONTROLLERS))
    lost_role = F.lit(False)
    for role in R.CONTROLLERS:
        lost_role = lost_role | F.contains(t, F.lit(role)) & ~F.contains(s, F.lit(role))
    return (
        F.when(either("发行人本部"), "parent scope")
        .when((owner(target) != "") & (owner(source) != "") & (owner(target) != owner(source)), "owner role")
        .when(unchanged & (lost_role | ~s.rlike("变更|变化")), "control change")
        .when((t.rlike(errors) != s.rlike(errors)) & F.when(t.rlike(errors), s).otherwise(t).rlike("会计政策|会计估计"), "accounting error")
        .when((F.size(denied(t)) > 0) & (F.size(denied(s)) > 0) & (denied(t) != denied(s)), "denied object")
        .when(either("保证人"), "guarantor")
        .when(under(source, "风险") & ~under(target, "风险") & ~F.contains(t, F.lit("风险")), "risk section")
        .otherwise(described)
    )


def replacement_risks(target_text: Column, source_text: Column, lost_rows: Column) -> Column:
    """Reasons why a source would lose something of a target that isn't the same."""
    unit = lambda c: F.regexp_extract(c, R.UNIT_IN_LINE, 1)
    return F.array_compact(
        F.array(
            F.when((F.length(target_text) > 120) & (F.length(T.compact(source_text)) < 0.78 * F.length(T.compact(target_text))), "shorter"),
            F.when(F.size(lost_rows) > 0, "lost row labels"),
            F.when((unit(target_text) != "") & (unit(source_text) == ""), "lost unit"),
            F.when((unit(target_text) != "") & (unit(source_text) != "") & (unit(target_text) != unit(source_text)), "changed unit"),
            F.when(target_text.rlike(R.PARENT_HEADINGS) & ~source_text.rlike(R.PARENT_HEADINGS), "lost parent scope"),
            F.when(target_text.rlike("[0-9]%") & target_text.rlike("持股|占比") & ~source_text.rlike("[0-9]%"), "lost share"),
        )
    )


def assessed(ranked: DataFrame) -> DataFrame:
    """``target, status, rule`` from ranked candidates: ``rank, score, literal, heading, exact, warned, vetoed, risks, key``.

    The order of the rules is part of the result: conflicting twins, the source's own warnings, exact copies, vetoes,
    lost content, unique wording, unique heading; weak rests are missing, others go to review.
    """
    best = ranked.where("rank = 1")
    others = ranked.where("rank > 1").join(best.select("target", F.col("key").alias("best_key"), F.col("score").alias("top")), "target")
    apart = others.where("key != best_key").groupBy("target").agg(F.max("score").alias("next_score"), F.max("literal").alias("next_literal"), F.bool_or((F.col("top") - F.col("score") < 0.04) & F.col("twin")).alias("twins"))
    judged = best.join(apart, "target", "left")
    margin = F.col("score") - F.coalesce("next_score", F.lit(0.0))
    lead = F.col("literal") - F.coalesce("next_literal", F.lit(0.0))
    rules = [
        (F.coalesce("twins", F.lit(False)), "review", "conflicting twins"),
        (F.col("warned"), "review", "source warning"),
        (F.col("exact"), "auto", "exact"),
        (F.col("vetoed"), "review", "veto"),
        (F.size("risks") > 0, "review", "risk"),
        ((F.col("literal") >= 0.97) & (F.col("score") >= 0.80) & (lead >= 0.08), "auto", "unique wording"),
        ((F.col("heading") >= 0.985) & (F.col("score") >= 0.75), "auto", "same heading"),
        ((F.col("heading") >= 0.985) & (F.col("literal") >= 0.90) & (margin >= 0.05), "auto", "same heading and wording"),
        (F.col("score") < 0.52, "missing", "weak"),
    ]
    status, rule = F.lit("review"), F.lit("unsure")
    for holds, s, r in reversed(rules):
        status, rule = F.when(holds, s).otherwise(status), F.when(holds, r).otherwise(rule)
    return judged.select("target", status.alias("status"), rule.alias("rule"))


def transactions(proposals: DataFrame) -> DataFrame:
    """``proposals`` and ``transaction``: neighbours of one heading and source that follow each other share one."""
    order = Window.partitionBy("doc").orderBy("index")
    same = (F.col("index") - F.lag("index").over(order) == 1) & F.col("heading_key").eqNullSafe(F.lag("heading_key").over(order)) & F.col("source").eqNullSafe(F.lag("source").over(order))
    return proposals.withColumn("new_", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("transaction", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def transaction_summary(proposals: DataFrame) -> DataFrame:
    """``doc, transaction, n, pending, kept``: whether any part waits and whether all parts are kept."""
    return proposals.groupBy("doc", "transaction").agg(F.count("*").alias("n"), F.bool_or(F.col("decision") == "pending").alias("pending"), F.bool_and(F.col("decision") == "keep").alias("kept"))
