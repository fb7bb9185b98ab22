"""Identities of tables and paragraphs, and the first veto between two of them."""

from pyspark.sql import functions as F

from quillmesh.operators import guards as G

BLOCK = "struct<text:string,path:array<string>,lines:array<string>,matrices:array<array<array<string>>>>"
HEAD = [["项目", "金额（万元）"], ["甲", "1"]]


def vetoes(spark, cases):
    rows = spark.createDataFrame([(t, s, w) for t, s, w in cases], f"t {BLOCK}, s {BLOCK}, want string")
    return [(r.want, r.got) for r in rows.select("want", G.descriptor_veto(F.col("t"), F.col("s")).alias("got")).collect()]


def shown(*lines, path=(), matrix=HEAD, n=1):
    return ("", list(path), list(lines), [matrix] * n)


def prose(text, *path):
    return (text, list(path), None, None)


def test_vetoes_of_tables(spark):
    t = shown("表：2020年营业收入")
    cases = [
        (t, t, ""),
        (t, shown("表：2020年营业成本"), "measures"),
        (t, shown("表：2021年营业收入"), "periods"),
        (t, shown("表：2020年营业收入", n=2), "number of tables"),
        (t, shown("表：2020年营业收入", "单位：元"), "units"),
        (t, shown("表：2020年营业收入", path=["母公司财务报表"]), "scope"),
        (shown("表：2020年客户"), shown("表：2020年供应商"), "parties"),
        (shown("表：2020年客户", matrix=[["供应商", "金额"], ["甲", "1"]]), t, "caption against header"),
        (shown("表：2020年电力业务"), shown("表：2020年食品业务"), "businesses"),
        (shown("表：某表"), shown("表：2020年某表"), ""),  # what one side alone tells vetoes nothing
        (shown("表：2021年营业收入", path=["母公司报表"]), shown("表：2020年营业成本"), "scope"),  # the first reason
    ]
    assert [c for c in vetoes(spark, cases) if c[0] != c[1]] == []


def test_vetoes_of_paragraphs(spark):
    cases = [
        (prose("报告期内，营业收入分别为1元和2元"), prose("报告期内，营业成本分别为1元和2元"), "measures"),
        (prose("提及营业收入"), prose("营业成本余额为1元"), ""),
        (prose("电力业务收入分别为1元"), prose("食品业务收入分别为1元"), "businesses"),
        (prose("甲乙丙丁有限公司成立于2001年"), prose("甲乙丙戊有限公司成立于2001年"), "named company"),
        (prose("甲乙丙丁有限公司是客户"), prose("甲乙丙戊有限公司是客户"), ""),
        (prose("资产如下", "一、保证人基本情况"), prose("资产如下"), "scope"),
        (prose("发行人本部资产如下"), prose("资产如下"), "scope"),
        (prose("资产如下", "母公司财务", "合并及母公司财务报表"), prose("资产如下", "本部财务"), ""),
        (prose("资产如下", "母公司财务", "合并财务报表"), prose("资产如下"), ""),  # the nearest heading decides
        (prose(None), prose(""), ""),
        (prose("资产如下", "母公司财务"), shown("表：某表"), "scope"),
    ]
    assert [c for c in vetoes(spark, cases) if c[0] != c[1]] == []


def test_identity(spark):
    rows = [
        (["表1：前五大客户", "单位：万元、％"], [[["项目", "2020年末", "2021年末"], ["", "金额", "金额"], ["甲（吨）", "2019年", "1"]]], ["业务", "（一）核查情况"]),
        ([], [[["名称", "数量（吨）"], ["甲", "2019年"]]], ["2018年主营业务收入", "一、调查情况"]),
        (None, None, None),
    ]
    frame = spark.createDataFrame(rows, "lines array<string>, m array<array<array<string>>>, path array<string>")
    a, b, c = (r.i for r in frame.select(G.table_identity(F.col("lines"), F.col("m"), F.col("path")).alias("i")).collect())
    assert (a.title, a.caption, a.periods, a.units, a.category) == ("表1：前五大客户", "表1：前五大客户", ["2020", "2021"], ["%", "万元"], "客户")
    assert (b.title, b.caption, b.periods, b.units, b.measures) == ("2018年主营业务收入", "", ["2018"], ["吨"], ["营业收入"])
    assert (c.title, c.periods, c.units, c.scope, c.tables, c.clash) == ("", [], [], "发行人", 0, False)


def test_same_table(spark):
    rows = spark.createDataFrame([(shown("表1：发行人2020年收入"), shown("表1： 公司2020年收入"), True), (shown("表1：2020年收入"), shown("表1：2020年支出"), False), (shown("表1：收入"), shown("表1：收入"), False)], f"t {BLOCK}, s {BLOCK}, want boolean")
    about = lambda x: G.table_identity(F.col(f"{x}.lines"), F.col(f"{x}.matrices"), F.col(f"{x}.path"))
    assert all(r.want == r.got for r in rows.select(about("t").alias("t"), about("s").alias("s"), "want").select("want", G.same_table(F.col("t"), F.col("s")).alias("got")).collect())
