"""Facts and checks: tolerances, equations, percentages, gaps, missing items, intervals. All DECIMAL, none DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflicts(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``key, n_facts, conflict``: whether the values of a key differ from its first one by more than both tolerances.

    That is so exactly if the key has more than one value that is distinct within tolerance.
    """
    first = F.min_by(F.struct("value", "tolerance"), F.struct(*order))
    firsts = facts.groupBy(*key).agg(first.alias("first_"))
    differs = F.abs(F.col("value") - F.col("first_.value")) > F.greatest("tolerance", "first_.tolerance")
    return facts.join(firsts, key).groupBy(*key).agg(F.count("*").alias("n_facts"), F.bool_or(differs).alias("conflict"))


def target_checks(targets: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """``targets`` and ``verdict``: ``match`` if a source fact of the key agrees within tolerance, ``differs`` if there
    are facts and none does, ``unknown`` without any."""
    t = targets.withColumn("row_", F.monotonically_increasing_id())
    s = sources.select(*(F.col(k).alias(f"{k}_s") for k in key), F.col("value").alias("value_s"), F.col("tolerance").alias("tolerance_s"))
    agrees = F.abs(F.col("value") - F.col("value_s")) <= F.greatest("tolerance", "tolerance_s")
    on = [F.col(k) == F.col(f"{k}_s") for k in key]
    verdicts = t.join(s, on, "left").groupBy("row_", *targets.columns).agg(F.bool_or(agrees).alias("ok_"))
    return verdicts.select(*targets.columns, F.when(F.col("ok_"), "match").when(~F.col("ok_"), "differs").otherwise("unknown").alias("verdict"))


def equation(facts: DataFrame, by: list[str], metric: str, total: str, parts: list[str]) -> DataFrame:
    """``by, gap, balanced`` where the total and all parts are known: the total less its parts, against all tolerances."""
    pick = lambda m, c: F.max(F.when(F.col(metric) == m, F.col(c)))
    wide = facts.groupBy(*by).agg(*(pick(m, c).alias(f"{m}_{c}") for m in [total, *parts] for c in ("value", "tolerance")))
    gap = F.col(f"{total}_value") - sum((F.col(f"{p}_value") for p in parts), F.lit(0).cast("decimal(38,12)"))
    allowed = F.col(f"{total}_tolerance") + sum((F.col(f"{p}_tolerance") for p in parts), F.lit(0).cast("decimal(38,12)"))
    return wide.withColumn("gap", gap).where(F.col("gap").isNotNull()).select(*by, "gap", (F.abs("gap") <= allowed).alias("balanced"))


def percentage_bounds(part: Column, part_tolerance: Column, whole: Column, whole_tolerance: Column) -> tuple[Column, Column]:
    """The least and the most that part / whole, in percent, can be within the tolerances; for positive wholes."""
    return 100 * (part - part_tolerance) / (whole + whole_tolerance), 100 * (part + part_tolerance) / (whole - whole_tolerance)


def unit_scaled(value: Column, unit: Column, scale: dict[str, str]) -> Column:
    """A money value in ten thousand yuan."""
    out = F.lit(None).cast("decimal(38,12)")
    for name, factor in scale.items():
        out = F.when(unit == name, (value * F.lit(factor).cast("decimal(12,4)")).cast("decimal(38,12)")).otherwise(out)
    return out


def numbers_agree(a: Column, b: Column) -> Column:
    """Whether two lists of decimal texts agree in order, each pair rounded half up to the coarser one's places."""
    places = lambda n: F.length(F.regexp_extract(n, r"\.([0-9]+)", 1))

    def same(x: Column, y: Column) -> Column:
        keep = F.pow(F.lit(10.0), F.least(places(x), places(y)).cast("int")).cast("decimal(12,0)")
        number = lambda n: F.regexp_replace(n, "%", "").try_cast("decimal(26,8)")
        return F.round(number(x) * keep, 0) == F.round(number(y) * keep, 0)

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(same(x, y), F.lit(False))), lambda ok: ok)


def owners(blocks: DataFrame, intervals: DataFrame, by: str, at: str = "index") -> DataFrame:
    """``blocks`` and ``n_owners``: the half-open intervals [start, end) of the same ``by`` that hold a block.

    A running sum of starts and ends, so long intervals don't multiply rows.
    """
    edges = intervals.where("start < end").select(by, F.col("start").alias(at), F.lit(1).alias("step")).unionAll(intervals.where("start < end").select(by, F.col("end"), F.lit(-1)))
    steps = edges.groupBy(by, at).agg(F.sum("step").alias("step"))
    every = blocks.select(by, at).withColumn("mark_", F.lit(1)).unionByName(steps.select(by, at).withColumn("mark_", F.lit(0))).join(steps, [by, at], "left")
    window = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    # A step that meets a block comes twice; it counts at its own row alone.
    open_now = F.sum(F.when(F.col("mark_") == 0, F.col("step")).otherwise(0)).over(window)
    counted = every.withColumn("n_owners", open_now).where("mark_ = 1").select(by, at, F.coalesce("n_owners", F.lit(0)).alias("n_owners")).distinct()
    return blocks.join(counted, [by, at])


def overlaps(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Pairs of intervals of one ``by`` that overlap; rows have ``by, name, start, end`` (numbers).

    Of two that overlap, one holds the other's start. An interval lies in two bins at most of the smallest power of two
    that is no shorter, a start in one bin of each width that occurs, so the equi-join is on (key, width, bin) and gives
    each pair once. Neither a key's size nor a long interval multiplies the candidates.
    """

    def sides(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(F.col(by).alias(f"{side}_by"), F.col("name").alias(side), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))

    def held(holders: DataFrame, x: str, others: DataFrame, y: str, inside: Column) -> DataFrame:
        """Pairs where ``inside`` holds: a start of ``others`` lies in one of the ``holders``."""
        low, high = F.floor(f"{x}_start").cast("long"), F.floor(f"{x}_end").cast("long")
        wide = sides(holders, x).where(F.col(f"{x}_start") < F.col(f"{x}_end")).withColumn("bits_", F.when(high > low, F.length(F.bin(high - low))).otherwise(0))
        wide = wide.withColumn("bin_", F.explode(F.sequence(F.call_function("shiftright", low, "bits_"), F.call_function("shiftright", high, "bits_"))))
        widths = F.broadcast(wide.select("bits_").distinct())  # 64 at most
        points = sides(others, y).join(widths).withColumn("bin_", F.call_function("shiftright", F.floor(f"{y}_start").cast("long"), "bits_"))
        same = wide.withColumnRenamed(f"{x}_by", by).join(points.withColumnRenamed(f"{y}_by", by), [by, "bits_", "bin_"])
        return same.where(inside).where("a_start < b_end AND b_start < a_end").select(by, "a", "a_start", "a_end", "b", "b_start", "b_end")

    return held(a, "a", b, "b", F.expr("a_start <= b_start")).unionByName(held(b, "b", a, "a", F.expr("b_start < a_start")))


def uncovered(blocks: DataFrame, copies: DataFrame, by: list[str]) -> DataFrame:
    """Blocks that no copy accounts for: set difference by key."""
    return blocks.join(copies.select(*by).distinct(), by, "left_anti")


def missing_siblings(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Source items ``parent, key, pos`` whose key their parent lacks in the target, with the nearest matched siblings.

    A parent counts if enough of its items are matched: all of one or two, else three and sixty per cent at least.
    """
    have = targets.select("parent", "key").distinct().withColumn("matched", F.lit(True))
    marked = sources.join(have, ["parent", "key"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    order = Window.partitionBy("parent").orderBy("pos", "key")
    found = F.when(F.col("matched"), F.col("key"))
    placed = (
        marked.withColumn("before", F.last(found, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("after", F.first(found, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("n", F.count("*").over(Window.partitionBy("parent")))
        .withColumn("support", F.sum(F.col("matched").cast("int")).over(Window.partitionBy("parent")))
    )
    needed = F.when(F.col("n") < 3, F.col("n") - 1).otherwise(F.greatest(F.lit(3), F.ceil(F.col("n") * 3 / 5)))
    return placed.where(~F.col("matched") & (F.col("support") >= F.least(needed, F.col("n") - 1)) & (F.col("support") > 0)).select("parent", "key", "pos", "before", "after")


def margin_top(rows: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The best row of each group and ``margin``: how far it leads the next one (null if alone)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return rows.withColumn("margin", F.col(score) - F.lead(score).over(order)).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def merged_findings(findings: DataFrame) -> DataFrame:
    """One row for each rule, block and title, with all details and evidence, sorted and distinct."""
    return findings.groupBy("rule", "block", "title").agg(F.array_sort(F.collect_set("detail")).alias("details"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def surplus_copies(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, surplus``: how much oftener a text stands in ``after`` than in ``before``, where it does."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = n(after, "now").join(n(before, "then"), key, "left")
    return both.withColumn("surplus", F.col("now") - F.coalesce("then", F.lit(0))).where("surplus > 0").select(key, "surplus")


def extend_on_diagonal(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``index, source, anchor`` that an unbroken run on their diagonal joins to an anchor, the anchors with them.

    The fixed point of adding neighbours of accepted rows, found at once: runs of a diagonal that hold an anchor.
    """
    diagonal = rows.withColumn("diagonal_", F.col("source") - F.col("index"))
    order = Window.partitionBy(*by, "diagonal_").orderBy("index")
    runs = diagonal.withColumn("run_", F.col("index") - F.row_number().over(order))
    whole = Window.partitionBy(*by, "diagonal_", "run_")
    return runs.withColumn("ok_", F.max(F.col("anchor").cast("int")).over(whole)).where("ok_ = 1").drop("diagonal_", "run_", "ok_")
