"""Behaviour of the analysis on small documents written for these tests."""

import pytest

from quillmesh.operators import resolve
from quillmesh.plans.analyze import analyze

LABELS = ["货币资金及其他流动资产", "应收账款及应收票据合计", "预付款项及其他应收款", "存货及合同资产账面价值", "固定资产及在建工程净额"]


def sheet(header, value):
    """A table with one row for each label."""
    width = header.count("|")
    return "\n".join([header, *("|".join([label, *[str(value)] * width]) for label in LABELS)])


OPENING, CLOSING = "现就有关情况说明如下：", "特此说明。"


def blocks(texts):
    """(kind, text) rows from texts; a text with a bar is a table."""
    return [("table" if "|" in t else "paragraph", t) for t in texts]


@pytest.fixture(scope="module")
def run(spark):
    def _run(source, *targets):
        s = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(blocks(source))], "index int, kind string, text string")
        rows = [(f"d{n}", i, k, t) for n, body in enumerate(targets) for i, (k, t) in enumerate(blocks(["某某关于本次发行的文件", OPENING, *body, CLOSING]))]
        t = spark.createDataFrame(rows, "doc string, index int, kind string, text string")
        found = analyze(s, t).collect()
        return [{r["index"] - 2: r.asDict(True) for r in found if r["doc"] == f"d{n}"} for n in range(len(targets))]

    return _run


FACT = "截至报告期末，发行人注册资本为人民币{}万元，法定代表人为张三，住所位于某市某区某路一百号，主要从事城市基础设施建设业务。"
STABLE = "发行人已建立健全的公司治理结构，董事会由九名董事组成，其中独立董事三名，监事会由五名监事组成并依法履行监督职责。"


def test_statuses_of_one_analysis(run):
    source = [
        "第一章 发行人情况",
        FACT.format("12,000"),
        STABLE,
        "单位：万元",
        sheet("项目|2021年|2020年|2019年", 9),
        "单位：万元",
        "科目|本期\n存货|77",
        "报告期内，公司控股股东持股比例为70.000%，股权结构清晰稳定，不存在重大权属纠纷情形；其他事项另行披露。",
    ]
    one = [
        "一、本公司情况",
        FACT.format("10,000").replace("发行人", "公司"),
        STABLE.replace("发行人", "公司"),
        "单位：万元",
        sheet("项目|2021年|2019年", 1),
        "本段为目标文件自身的分析判断，与任何来源均无对应关系，应当予以保留且不作修改。",
    ]
    mixed = ["单位：万元", sheet("项目|2021年|2020年|2019年", 9) + "\n同行业平均水平|1|1|1"]
    a, b = run(source, one, mixed)
    assert a[1]["status"] == "ready" and a[1]["source_index"] == 1 and "12,000" in a[1]["new_text"]
    assert a[0]["status"] == "wording" and a[0]["new_text"] == "一、公司情况"
    assert a[2]["status"] == "ready" and a[2]["same_visible"]
    assert a[4]["status"] == "ready" and a[4]["table_projection"] == [0, 1, 3]
    assert a[3]["status"] == "ready" and a[3]["source_index"] == 3
    assert a[5]["status"] == "retained" and not a[5]["review_required"]
    assert b[1]["status"] == "retained" and b[0]["status"] == "retained" and b[0]["source_index"] is None
    assert -2 not in a and -1 not in a  # title and opening lie outside the body


def test_percentage_drift_and_containment(run):
    source = [
        "第一章 发行人情况",
        "报告期内，公司控股股东持股比例为70.000%，股权结构清晰稳定且不存在重大权属纠纷；截至目前该股东未将所持股份质押，也不存在其他权利限制的情况；公司治理规范运行。",
        "其他无关的段落，介绍公司所处行业以及上下游的竞争格局和未来发展趋势。",
    ]
    (a,) = run(source, ["报告期内，公司控股股东持股比例为68.336%，股权结构清晰稳定且不存在重大权属纠纷。"])
    assert a[0]["status"] == "ready" and a[0]["source_index"] == 1 and a[0]["segment"].startswith("报告期内")
    (b,) = run(source, ["报告期内，公司控股股东持股比例为70.000%，股权结构清晰稳定且不存在重大权属纠纷。"])
    assert b[0]["status"] == "ready" and b[0]["segment"] is None


def test_structural_gap(run):
    anchor = "公司董事会负责制定年度经营计划、投资方案以及财务预算方案，并对股东会负责和报告工作情况{}。"
    source = ["第一章 组织结构", anchor.format("甲乙丙丁"), "5、法务合规部", "负责全公司合同审查与法律事务处理。", anchor.format("戊己庚辛壬癸子丑寅卯")]
    (a,) = run(source, [anchor.format("甲乙丙丁"), "5、综合管理部", "主管行政接待、后勤保障以及车辆调度。", anchor.format("戊己庚辛壬癸子丑寅卯")])
    assert a[2]["status"] == "ready" and a[2]["source_index"] == 3
    assert 1 not in a  # the heading stays the target's own


def test_nothing_without_sources_or_targets(spark):
    s = spark.createDataFrame([], "index int, kind string, text string")
    t = spark.createDataFrame([], "doc string, index int, kind string, text string")
    assert analyze(s, t).count() == 0


def test_decisions(spark):
    cand = "array<struct<source_index:int,score:double,literal:double>>"
    p = spark.createDataFrame(
        [("a", "ready", 3, []), ("b", "review", None, [(5, 0.7, 0.7)]), ("c", "review", None, [(5, 0.7, 0.7)]), ("d", "retained", None, []), ("e", "review", None, [])],
        f"id string, status string, source_index int, candidates {cand}",
    )
    d = spark.createDataFrame([("a", "keep", None), ("b", "update", 5), ("c", "update", 9), ("d", "update", 1)], "id string, decision string, source_index int")
    got = {r["id"]: (r["decision"], r["source_index"]) for r in resolve.decided(p, d).collect()}
    assert got == {"a": ("keep", 3), "b": ("update", 5), "c": ("blocked", None), "d": ("keep", None), "e": ("keep", None)}


def test_content_of_ready_rows(run):
    long = "报告期内，公司控股股东持股比例为70.000%，股权结构清晰稳定且不存在重大权属纠纷；截至目前该股东未将所持股份质押，也不存在其他权利限制的情况；公司治理规范运行。"
    source = ["第一章 发行人情况", long, STABLE, sheet("项目|2021年|2020年|2019年", 9)]
    own = "报告期内，公司控股股东持股比例为70.000%，股权结构清晰稳定且不存在重大权属纠纷。"
    (a,) = run(source, [own, STABLE.replace("发行人", "公司") + "（二）后续安排", sheet("项目|2021年|2019年", 1)])
    assert a[0]["mode"] == "summary" and a[0]["new_text"] == own
    assert a[1]["mode"] == "body" and a[1]["new_text"] == STABLE.replace("发行人", "公司") + "（二）后续安排"
    assert a[2]["mode"] == "columns" and a[2]["new_cells"] == [["项目", "2021年", "2019年"], *([label, "9", "9"] for label in LABELS)]
    assert a[2]["new_text"].split("\n")[1] == f"{LABELS[0]}|9|9"


def test_a_reviewers_pick_brings_its_text(spark):
    cand = "array<struct<source_index:int,score:double,literal:double>>"
    p = spark.createDataFrame([("b", "review", "old", None, [(5, 0.7, 0.7)], None, None)], f"id string, status string, text string, source_index int, candidates {cand}, new_text string, new_cells array<array<string>>")
    d = spark.createDataFrame([("b", "update", 5)], "id string, decision string, source_index int")
    s = spark.createDataFrame([(4, "paragraph", "其他"), (5, "paragraph", "发行人的新文本")], "index int, kind string, text string")
    row = resolve.decided(p, d, s).first()
    assert (row.decision, row.source_index, row.new_text, row.new_cells) == ("update", 5, "公司的新文本", None)


def test_a_picked_table_keeps_its_scanned_cells(spark):
    cand = "array<struct<source_index:int,score:double,literal:double>>"
    p = spark.createDataFrame([("b", "review", "old", None, [(5, 0.7, 0.7)], None, None)], f"id string, status string, text string, source_index int, candidates {cand}, new_text string, new_cells array<array<string>>")
    d = spark.createDataFrame([("b", "update", 5)], "id string, decision string, source_index int")
    cells = [[("a bar | in it",), ("two\nparagraphs",)], [("1",), ("2",)]]
    s = spark.createDataFrame([(5, "table", "a bar | in it|two\nparagraphs\n1|2", cells)], "index int, kind string, text string, cells array<array<struct<text:string>>>")
    assert resolve.decided(p, d, s).first().new_cells == [["a bar | in it", "two\nparagraphs"], ["1", "2"]]


def test_a_table_of_many_documents_is_folded_in_order_and_apart(spark):
    from quillmesh.operators import context

    cand = [(4, 0.9, 0.9), (9, 0.85, 0.85)]
    rows = [(d, i, "paragraph", False, 200, cand if i % 2 else None, [4] if d == 1 else None, [6] if i == 2 else None, False) for d in (None, *range(60)) for i in (3, 1, 2, 0)]
    kinds = f"doc int, index int, kind string, structural boolean, n_chars int, candidates array<{context.CANDIDATE}>, blocked array<int>, figure array<int>, wording boolean"
    got = context.folded(spark.createDataFrame(rows, kinds).repartition(7)).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: r["index"]):
        by_doc.setdefault(r["doc"], []).append((r["index"], r["status"], r["source_index"]))
    assert by_doc.pop(1) == [(0, "review", None), (1, "review", None), (3, "review", None)]
    assert len(by_doc) == 60 and all(v == [(0, "review", None), (1, "ready", 4), (2, "ready", 6), (3, "ready", 9)] for v in by_doc.values()), by_doc


def test_lines_and_tables_are_scored_by_one_count_of_grams_each(spark):
    from quillmesh.operators import match

    s = spark.createDataFrame([(0, "paragraph", STABLE, STABLE), (1, "table", "a|b", "a|b" * 9)], "index int, kind string, text string, n string")
    t = spark.createDataFrame([("d", 0, "paragraph", STABLE, STABLE)], "doc string, index int, kind string, text string, n string")
    plan = match.fuzzy_candidates(t, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "s_n" not in plan
