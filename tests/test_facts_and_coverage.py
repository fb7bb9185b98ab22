"""Facts, guards and coverage on rows given here."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import coverage as K
from quillmesh.operators import facts as X

BLOCK = "doc string, index int, kind string, text string, heading boolean, path array<string>, is_toc boolean, drawing boolean"


@pytest.fixture(scope="module")
def frame(spark):
    def _frame(*texts, path=("第一章 发行人",)):
        rows = [("d", i, "table" if "|" in t else "paragraph", t, t.startswith("第"), list(path), False, False) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, BLOCK)

    return _frame


def told(facts):
    return sorted((r["metric"], r["period"], r["scope"], r["unit"], float(r["value"]), float(r["tolerance"])) for r in facts.collect())


def test_prose_facts(frame):
    found = X.extract_facts(
        frame(
            "报告期：2019年、2020年",
            "2019年末和2020年末，发行人总资产分别为12.5亿元和3,000.0万元，其他略。",
            "报告期内，公司资产负债率分别为51.2%和60%，保持稳定。",
            "2020年度，某某板块营业收入为5万元。",
            "2020年度，公司扣除非经常性损益后净利润为7万元。",
        )
    )
    assert told(found) == [
        ("资产总额", "2019", "发行人", "亿元", 125000.0, 500.0),
        ("资产总额", "2020", "发行人", "万元", 3000.0, 0.05),
        ("资产负债率", "2019", "发行人", "%", 51.2, 0.05),
        ("资产负债率", "2020", "发行人", "%", 60.0, 0.5),
    ]


def test_table_facts(frame):
    found = X.extract_facts(frame("单位：万元", "项目|2020年末|2019年末|占比\n资产总计|1,000|900|100\n无关|1|2|3\n资产负债率（%）|50.1|49|1", "第二章", "项目|2020年\n净利润|5", "项目|发行后\n净利润|5"))
    assert told(found) == [("资产总额", "2019", "发行人", "万元", 900.0, 0.5), ("资产总额", "2020", "发行人", "万元", 1000.0, 0.5), ("资产负债率", "2019", "发行人", "%", 49.0, 0.5), ("资产负债率", "2020", "发行人", "%", 50.1, 0.05)]
    other = X.extract_facts(frame("单位：万元", "项目|2020年\n净利润|5", path=("保证人情况",)))
    assert told(other)[0][2] == "保证人"


def test_amount_and_shares(frame, spark):
    assert [float(r.amount) for r in X.bond_amount(frame("发行规模为10亿元。", "发行总额不超过100,000万元。")).collect()] == [100000.0]
    assert X.bond_amount(frame("发行规模为10亿元。", "发行规模为9亿元。")).count() == 0
    number = lambda *names: [F.col(n).cast("decimal(30,10)").alias(n) for n in names]
    shares = spark.createDataFrame([("d", "2020", 50.0, 0.5, 25.0, 0.05), ("d", "2020", 50.0, 0.5, 30.0, 0.05)], "doc string, period string, part double, part_tolerance double, percent double, percent_tolerance double")
    shares = shares.select("doc", "period", *number("part", "part_tolerance", "percent", "percent_tolerance"))
    totals = spark.createDataFrame([("d", "2020", 200.0, 0.5)], "doc string, period string, value double, tolerance double").select("doc", "period", *number("value", "tolerance"))
    assert sorted((float(r.percent), r.ok) for r in X.asset_share_checks(shares, totals).collect()) == [(25.0, True), (30.0, False)]


def test_guards(spark):
    pair = "struct<text:string,path:array<string>>"
    cases = [
        (("总资产为1亿元", ["母公司口径"]), ("总资产为1亿元", ["合并口径"]), "parent scope"),
        (("发行人控股股东为甲", []), ("发行人实际控制人为甲", []), "owner role"),
        (("公司控股股东未发生变更", []), ("公司控股股东为甲", []), "control change"),
        (("不存在会计差错更正", []), ("会计政策变更如下", []), "accounting error"),
        (("公司不存在对外担保", []), ("公司不存在重大诉讼", []), "denied object"),
        (("注册资本", ["保证人情况"]), ("注册资本", []), "guarantor"),
        (("注册资本", []), ("注册资本", ["风险提示"]), "risk section"),
        (("注册资本", []), ("注册资本", []), ""),
    ]
    rows = spark.createDataFrame([(t, s, w) for t, s, w in cases], f"t {pair}, s {pair}, want string")
    assert all(r.got == r.want for r in rows.select(K.subject_guard().alias("got"), "want").collect())
    risks = spark.createDataFrame([("单位：万元 持股比例为5%", "单位：元")], "t string, s string").select(K.replacement_risks(F.col("t"), F.col("s"), F.array(F.lit("行"))).alias("r")).first().r
    assert risks == ["lost row labels", "changed unit", "lost share"]  # a short text has nothing to lose by length
    sizes = spark.createDataFrame([("甲" * 120, "甲" * 60), ("甲" * 121, "甲" * 60), ("甲" * 121, "甲" * 100)], "t string, s string")
    found = sizes.select(K.replacement_risks(F.col("t"), F.col("s"), F.array().cast("array<string>")).alias("r")).collect()
    assert [r.r for r in found] == [[], ["shorter"], []]


def test_merges_and_quotes(spark):
    first, rest = "甲" * 45 + "。", "乙" * 50 + "。"
    targets = spark.createDataFrame([("d", 0, first + "旧句。", "标题内容"), ("d", 1, "", "标题内容"), ("d", 2, rest, "标题内容")], "doc string, index int, text string, heading_key string")
    sources = spark.createDataFrame([(7, first + rest, "标题内容")], "index int, text string, heading_key string")
    assert [tuple(r) for r in K.paragraph_merges(targets, sources).collect()] == [("d", 0, 2, 7)]
    full = targets.union(spark.createDataFrame([("d", 3, rest, "标题内容")], targets.schema)).where("index != 1")
    assert K.paragraph_merges(full, sources).collect()[0]["consumed"] == 2
    lead = "“1.2 " + "丙" * 45 + "："
    t = spark.createDataFrame([("d", 0, lead), ("d", 1, "丁"), ("d", 2, "戊”"), ("d", 3, "己")], "doc string, index int, text string")
    s = spark.createDataFrame([(4, lead[1:]), (5, "丁"), (6, "戊”")], "index int, text string")
    copied = spark.createDataFrame([("d", 1, 5), ("d", 2, 6)], "doc string, index int, source_index int")
    assert [tuple(r) for r in K.quoted_clauses(t, s, copied).collect()] == [("d", 0, 4)]
    assert K.quoted_clauses(t, s, copied.where("index = 1")).count() == 0


def test_bundles_and_transactions(spark):
    texts = ["正文", "表：甲", "单位：元", "a|b\n1|2", "注：略", "正文", "c|d\n3|4"]
    blocks = spark.createDataFrame([("d", i, "table" if "|" in t else "paragraph", t) for i, t in enumerate(texts)], "doc string, index int, kind string, text string")
    assert sorted((r["index"], r["start"], r["end"]) for r in K.table_bundles(blocks).collect()) == [(3, 1, 5), (6, 6, 7)]
    rows = [("d", 0, "h", "s", "keep"), ("d", 1, "h", "s", "pending"), ("d", 3, "h", "s", "keep"), ("d", 4, "k", "s", "keep")]
    done = K.transaction_summary(K.transactions(spark.createDataFrame(rows, "doc string, index int, heading_key string, source string, decision string")))
    assert sorted((r.transaction, r.n, r.pending, r.kept) for r in done.collect()) == [(1, 2, True, False), (2, 1, False, True), (3, 1, False, True)]


def test_assessment(spark):
    schema = "target int, rank int, score double, literal double, heading double, exact boolean, warned boolean, vetoed boolean, risks array<string>, key string, twin boolean"
    no = (False, False, False, [])
    rows = [
        (1, 1, 1.0, 1.0, 1.0, True, False, False, [], "a", False),
        (2, 1, 0.9, 0.99, 0.0, *no, "a", False), (2, 2, 0.5, 0.6, 0.0, *no, "b", False),
        (3, 1, 0.9, 0.99, 0.0, *no, "a", False), (3, 2, 0.88, 0.6, 0.0, *no, "b", True),
        (4, 1, 0.8, 0.8, 0.99, *no, "a", False),
        (5, 1, 0.4, 0.4, 0.0, *no, "a", False),
        (6, 1, 0.7, 0.7, 0.5, *no, "a", False),
        (7, 1, 0.9, 0.99, 1.0, False, False, False, ["shorter"], "a", False),
    ]
    got = {r.target: (r.status, r.rule) for r in K.assessed(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("auto", "exact"), 2: ("auto", "unique wording"), 3: ("review", "conflicting twins"), 4: ("auto", "same heading"), 5: ("missing", "weak"), 6: ("review", "unsure"), 7: ("review", "risk")}


def test_missing_siblings_by_support(spark):
    from quillmesh.operators.reconcile import missing_siblings

    sources = spark.createDataFrame([(p, k, i) for p, keys in (("a", "uvwxy"), ("b", "uvwxy"), ("c", "uv"), ("d", "u")) for i, k in enumerate(keys)], "parent string, key string, pos long")
    targets = spark.createDataFrame([("a", "u"), ("a", "w"), ("a", "w"), ("a", "y"), ("b", "u"), ("b", "v"), ("c", "v"), ("e", "u")], "parent string, key string")
    got = {tuple(r) for r in missing_siblings(targets, sources).collect()}
    # "b" has two of five, which is too few; "d" has none; "e" isn't in the sources
    assert got == {("a", "v", 1, "u", "w"), ("a", "x", 3, "w", "y"), ("c", "u", 0, None, "v")}
    assert missing_siblings(targets.limit(0), sources).count() == 0


def test_a_heading_over_both_statements_decides_nothing(spark):
    from quillmesh.operators import facts

    rows = [(["合并及母公司财务报表"],), (["母公司财务报表"],), (["母公司财务报表", "合并及母公司财务报表"],), (["合并财务报表与母公司财务报表"],)]
    got = [r.s for r in spark.createDataFrame(rows, "path array<string>").select(facts.scope_of(F.col("path"), F.lit("")).alias("s")).collect()]
    assert got == ["发行人", "发行人本部", "发行人本部", "发行人"]
