"""Facts from prose and tables: metric, period, scope, exact value and the tolerance that its digits show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.blocks import in_order
from quillmesh.operators.reconcile import unit_scaled
from quillmesh.plans import fact_rules as R
from quillmesh.plans.rules import CLAUSE, SPACE, Units

FACT = ["doc", "index", "metric", "period", "scope", "unit", "value", "tolerance", "display"]


def _plain(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, SPACE, ""), "−－", "--")


def scope_of(path: Column, tail: Column) -> Column:
    """Whose figure it is: by the nearest deciding heading, else by what stands right before the metric.

    A heading over both the consolidated and the parent's statements decides nothing.
    """
    decides = "|".join((R.GUARANTOR_HEADINGS, R.PARENT_HEADINGS, R.OTHER_HEADINGS, R.IMPACT_HEADINGS))
    nearest = F.coalesce(F.get(F.filter(F.reverse(path), lambda h: h.rlike(decides) & ~(h.rlike(R.PARENT_HEADINGS) & h.rlike(R.BOTH_STATEMENTS))), F.lit(0)), F.lit(""))
    last = F.regexp_extract(tail, "([^，,；;。]*)$", 1)
    return (
        F.when(nearest.rlike(R.GUARANTOR_HEADINGS), "保证人")
        .when(nearest.rlike(R.PARENT_HEADINGS), "发行人本部")
        .when(nearest.rlike(R.IMPACT_HEADINGS), "发行模拟")
        .when(nearest.rlike(R.OTHER_HEADINGS), "其他主体")
        .when(last.rlike(R.SEGMENT_END), "业务分项")
        .when((F.length(last) > 2) & ~last.rlike(R.OWN_WORDS), "其他主体")
        .otherwise("发行人")
    )


def surrounding_unit(blocks: DataFrame) -> DataFrame:
    """``blocks`` and ``unit``: the nearest unit line within five blocks above, not past a heading."""
    line = F.regexp_extract(_plain(F.col("text")), R.UNIT_IN_LINE, 1)
    told = F.when(line != "", line).when(F.col("heading"), "")
    near = F.last(told, ignorenulls=True).over(in_order().rowsBetween(-5, -1))
    return blocks.withColumn("unit", F.coalesce(near, F.lit("")))


def _facts(rows: DataFrame) -> DataFrame:
    """Rows with ``raw`` (a number as written) and ``unit`` to facts."""
    scale = Units().scale
    number = T.decimal("raw")
    ratio = F.col("unit").isin("%", "倍")
    value = F.when(ratio, number).otherwise(unit_scaled(number, F.col("unit"), scale))
    tolerance = F.when(ratio, T.shown_tolerance("raw")).otherwise(unit_scaled(T.shown_tolerance("raw"), F.col("unit"), scale))
    return rows.withColumn("value", value).withColumn("tolerance", tolerance).withColumn("display", F.concat("raw", "unit")).where(F.col("value").isNotNull()).select(*FACT)


def table_facts(blocks: DataFrame) -> DataFrame:
    """Facts of table blocks ``doc, index, text, path, unit`` whose header names one period for each column."""
    split = lambda c, sep: F.transform(F.split(c, sep, -1), lambda x: _plain(x))
    matrix = blocks.where("kind = 'table'").withColumn("rows", F.transform(F.split("text", "\n", -1), lambda r: split(r, r"\|"))).withColumn("first", F.col("rows")[0]).where(~F.exists("first", lambda h: h.rlike(R.SCENARIO)))
    cells = matrix.select("doc", "index", "path", "unit", "first", "rows", F.posexplode("rows").alias("r", "row")).select(
        "doc", "index", "path", "unit", "first", "rows", "r", F.regexp_replace(F.regexp_replace(F.col("row")[0], "^[一二三四五六七八九十0-9]+[、.．]", ""), "[（(][%倍][)）]", "").alias("label"), F.posexplode("row").alias("c", "cell")
    )
    labels = F.create_map(*(F.lit(x) for pair in R.ROW_LABELS.items() for x in pair))
    shares = F.exists(F.slice("rows", 2, F.greatest(F.lit(0), F.least(F.col("r"), F.lit(3)) - 1)), lambda x: F.coalesce(F.get(x, F.col("c")).rlike(R.SHARE_COLUMN), F.lit(False)))
    known = (
        cells.where("c > 0")
        .withColumn("metric", F.try_element_at(labels, F.col("label")))
        .withColumn("p", T.periods(F.get("first", F.col("c"))))
        .where(F.col("metric").isNotNull() & (F.size("p") == 1) & F.col("cell").rlike(f"^{R.NUMBER}[%％]?$") & ~shares)
    )
    units = F.when(F.col("metric") == "资产负债率", "%").when(F.col("metric") == "流动比率", "倍").otherwise(F.col("unit"))
    rows = known.withColumn("unit", units).where("unit != ''").withColumn("period", F.col("p")[0]).withColumn("scope", scope_of(F.col("path"), F.lit(""))).withColumn("raw", F.regexp_replace("cell", "[%％]", ""))
    return _facts(rows)


def prose_facts(blocks: DataFrame, default_periods: DataFrame | None = None) -> DataFrame:
    """Facts of paragraphs: a metric, ``为`` or ``是``, and as many amounts as the periods told before it.

    One amount with several periods belongs to the last; clauses that speak of the reporting period take the document's
    ``default_periods`` (``doc, periods``). Figures of segments and other entities are passed over.
    """
    clause = blocks.where("kind = 'paragraph'").select("doc", "index", "path", _plain(F.col("text")).alias("s")).withColumn("parts", T.clauses("s"))
    clause = clause.select("doc", "index", "path", "parts", F.posexplode("parts").alias("k", "clause")).withColumn("before", F.array_join(F.slice("parts", 1, F.col("k")), ""))
    found = []
    for metric, pattern in R.METRICS.items():
        whole = f"^(.*?){pattern}(?:余额|账面价值)?(?:分别)?(?:为|是)([^。；;]{{0,130}})"
        groups = pattern.replace("(?:", "").count("(?<")
        found.append(F.struct(F.lit(metric).alias("metric"), F.regexp_extract("clause", whole, 1).alias("lead"), F.regexp_extract("clause", whole, 2).alias("amounts"), F.lit(groups).alias("g")))
    rows = clause.withColumn("m", F.explode(F.array(*found))).select("doc", "index", "path", "before", "m.metric", "m.lead", F.substring_index("m.amounts", "，", 1).alias("amounts")).where("amounts != ''")
    rows = rows.withColumn("prefix", F.concat("before", "lead")).where(~((F.col("metric") == "净利润") & F.expr("right(prefix, 18)").rlike("扣除|归属于|归母")))
    money = F.transform(F.regexp_extract_all("amounts", F.lit(f"({R.NUMBER})[\t ]*(亿元|万元|元)"), F.lit(0)), lambda v: F.struct(F.regexp_extract(v, R.NUMBER, 0).alias("raw"), F.regexp_extract(v, "(亿元|万元|元)$", 1).alias("unit")))
    ratios = lambda unit: F.transform(F.regexp_extract_all("amounts", F.lit(R.NUMBER), F.lit(0)), lambda v: F.struct(v.alias("raw"), F.lit(unit).alias("unit")))
    rows = rows.withColumn("values", F.when(F.col("metric") == "资产负债率", ratios("%")).when(F.col("metric") == "流动比率", ratios("倍")).otherwise(money)).where(F.size("values") > 0)
    rows = rows.withColumn("told", T.periods("prefix"))
    if default_periods is not None:
        rows = rows.join(default_periods.select("doc", F.col("periods").alias("default_")), "doc", "left")
        rows = rows.withColumn("told", F.when((F.size("told") == 0) & F.col("prefix").rlike("近[两二三]年|报告期|各期"), F.coalesce("default_", "told")).otherwise(F.col("told")))
    rows = rows.withColumn("told", F.when((F.size("values") == 1) & (F.size("told") > 1), F.slice("told", -1, 1)).otherwise(F.col("told"))).where(F.size("values") == F.size("told"))
    rows = rows.withColumn("scope", scope_of(F.col("path"), F.col("prefix"))).where(~F.col("scope").isin("业务分项", "其他主体"))
    rows = rows.select("doc", "index", "metric", "scope", F.explode(F.arrays_zip("told", "values")).alias("z")).select("doc", "index", "metric", "scope", F.col("z.told").alias("period"), F.col("z.values.raw").alias("raw"), F.col("z.values.unit").alias("unit"))
    return _facts(rows)


def glossary_periods(blocks: DataFrame, within: int = 250) -> DataFrame:
    """``doc, periods``: what the first line or table row that names the reporting period says."""
    lines = blocks.where(F.col("index") < within).select("doc", "index", F.posexplode(F.split("text", "\n", -1)).alias("r", "line"))
    row = F.split("line", r"\|", -1)[0]
    naming = (F.contains("line", F.lit("|")) & row.rlike("报告期|最近两年及一期") & ~F.contains(row, F.lit("末"))) | F.col("line").rlike("报告期[:：]")
    told = lines.where(naming).withColumn("periods", T.periods("line")).where(F.size("periods") > 0)
    return told.groupBy("doc").agg(F.min_by("periods", F.struct("index", "r")).alias("periods"))


def extract_facts(blocks: DataFrame) -> DataFrame:
    """All facts of blocks ``doc, index, kind, text, heading, path, is_toc, drawing``."""
    usable = surrounding_unit(blocks).where("NOT is_toc AND NOT drawing")
    return table_facts(usable).unionByName(prose_facts(usable, glossary_periods(blocks)))


def bond_amount(blocks: DataFrame) -> DataFrame:
    """``doc, amount`` where a document tells one issue size alone, in ten thousand yuan."""
    said = F.regexp_extract_all(_plain(F.col("text")), F.lit(r"发行(?:规模|总额|金额)(?:为|不超过)?(?:人民币)?([0-9,.]+(?:亿元|万元))"), F.lit(1))
    rows = blocks.select("doc", F.explode(said).alias("v")).select("doc", unit_scaled(T.decimal(F.regexp_replace("v", "[亿万]元", "")), F.regexp_extract("v", "(亿元|万元)", 1), Units().scale).alias("amount"))
    return rows.where("amount IS NOT NULL").groupBy("doc").agg(F.count_distinct("amount").alias("n"), F.min("amount").alias("amount")).where("n = 1").drop("n")


def asset_share_checks(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """``shares`` (``doc, period, part, part_tolerance, percent, percent_tolerance``) and ``ok``: whether the share of
    the total assets of that period can be what is shown, against every total that is told."""
    t = totals.select("doc", "period", F.col("value").alias("whole"), F.col("tolerance").alias("whole_tolerance"))
    low = 100 * (F.col("part") - F.col("part_tolerance")) / (F.col("whole") + F.col("whole_tolerance"))
    high = 100 * (F.col("part") + F.col("part_tolerance")) / (F.col("whole") - F.col("whole_tolerance"))
    inside = (F.col("percent") + F.col("percent_tolerance") >= low) & (F.col("percent") - F.col("percent_tolerance") <= high)
    return shares.join(t, ["doc", "period"]).groupBy(*shares.columns).agg(F.bool_and(inside).alias("ok"))


def latest_first(facts: DataFrame) -> DataFrame:
    """``facts`` and ``rank`` within a metric and scope, the latest period first."""
    return facts.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc", "metric", "scope").orderBy(F.desc("period"))))
