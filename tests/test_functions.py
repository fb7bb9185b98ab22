"""Scalar forms, similarity and checks, on rows given here."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import similarity as S
from quillmesh.functions import text as T
from quillmesh.operators import blocks as B
from quillmesh.operators import reconcile as C
from quillmesh.operators import tables


@pytest.fixture(scope="module")
def value(spark):
    def _value(column, **values):
        names = list(values)
        return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'double'}" for n in names)).select(column).first()[0]

    return _value


@pytest.mark.parametrize(
    ("form", "text", "want"),
    [
        (T.compact, " （甲），　乙。\t", "(甲),乙."),
        (T.compact, None, ""),
        (T.neutral, "截至本募集说明书签署之日，发行人与本公司", "截至<DATE>,<C>与<C>"),
        (T.adapt, "本募集说明书签署日，发行人", "本说明性文件出具日，公司"),
        (T.lead, "（三）标题", "（三）"),
        (T.after_lead, "3、标题", "标题"),
        (T.lead, "2021年", ""),
        (T.strip_lead, "第二章 发行 1.1", "发行 1.1"),
        (T.segment_key, "完整的一句。", "完整的一句"),
        (T.projection_normal, "截至本募集说明书签署日，公司（甲）", "甲"),
        (T.title_key, "一、公司 概况：", "公司概况"),
        (T.skeleton, "Rev 1,234.5 万元!", "rev#万元"),
        (T.safe_name, 'a/b:c*?"d', "a_b_c_d"),
        (T.row_key, "（1）货币资金（合并）：", "货币资金"),
    ],
)
def test_text_forms(value, form, text, want):
    assert value(form("x"), x=text) == want


def test_masks_and_shells(value):
    assert value(T.projection_normal("x", True), x="持股12.5%与7%") == "持股<P>与<P>"
    assert value(T.adapt_for("a", "b"), a="（一）发行人情况", b="1、概况") == "1、公司情况"
    assert value(T.adapt_for("a", "b"), a="发行人情况", b="1、概况") == "公司情况"
    assert value(T.structural_heading("x"), x="（一）公司治理") and not value(T.structural_heading("x"), x="（一）负责审计工作；")
    assert value(T.heading_level("x"), x="（一）公司治理") == 2 and value(T.heading_level("x"), x="单位：万元") is None
    assert str(value(T.decimal("x"), x="－1,234.50")) == "-1234.500000000000" and value(T.decimal("x"), x="无") is None
    assert float(value(T.shown_tolerance("x"), x="1.25")) == 0.005
    assert value(T.stable_id(F.lit("n"), F.lit(1), F.lit(-1), F.col("x")), x=" a b ") == value(T.stable_id(F.lit("n"), F.lit(1), F.lit(-1), F.col("x")), x="ab")
    assert value(S.nfkc("x"), x="ＡＢ①") == "AB1"


def test_ratio_against_a_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, x=x, row=row: row[j - 1] + 1 if x == b[j - 1] else max(left, row[j]), initial=0))
        assert S.lcs_length(a, b) == row[-1] and S.ratio(a, b) == S.ratio(b, a)
    assert S.ratio("abc", "abc") == 1 and S.ratio("", "") == 0 == S.ratio(None, "a")


def test_grams_and_sentences():
    assert S.grams_of("abcab", 2) == ["ab", "bc", "ca"] and S.grams_of("ab") == ["ab"] and S.grams_of(None) == []
    assert S.sentence_ends("甲。“乙。丙。”丁。戊") == [2, 10, 11] or S.sentence_ends("甲。“乙。丙。”丁。戊")[0] == 2
    assert S.sentence_ends("") == [] and S.sentence_ends("无") == [1]


def test_stack_and_scopes_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, i, f"t{i}", rng.choice([None, None, 0, 1, 2, 3, 9]), rng.random() < 0.1) for d in range(20) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc int, index int, text string, level int, is_toc boolean").withColumn("heading", F.col("level").isNotNull())
    got = {(r.doc, r["index"]): (r.path, r.scope_end) for r in B.scope_end(B.heading_path(frame)).collect()}
    for d in range(20):
        own, stack = [r for r in rows if r[0] == d], []
        for _, i, t, level, toc in own:
            if not toc and level is not None:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, t))
            assert got[d, i][0] == ([] if toc else [x for _, x in stack])
            if level is not None:
                stops = [j for _, j, _, other, contents in own if j > i and (contents or other is not None and other <= level)]
                assert got[d, i][1] == min(stops, default=30)


def test_conflicts_equal_greedy_distinct(spark):
    rng = random.Random(5)
    facts = [(g, i, round(rng.random(), 2), rng.choice([0.05, 0.2])) for g in range(60) for i in range(rng.randint(1, 5))]
    frame = spark.createDataFrame(facts, "g int, i int, v double, t double").select("g", "i", F.col("v").cast("decimal(38,12)").alias("value"), F.col("t").cast("decimal(38,12)").alias("tolerance"))
    got = {r.g: r.conflict for r in C.conflicts(frame, ["g"], ["i"]).collect()}
    for g in range(60):
        distinct = []
        for _, _, v, t in [f for f in facts if f[0] == g]:
            if all(round(abs(v - w), 6) > max(t, u) for w, u in distinct):
                distinct.append((v, t))
        assert got[g] == (len(distinct) > 1)


def test_interval_owners(spark):
    rng = random.Random(6)
    spans = [(g, a, a + rng.randint(-1, 6)) for g in range(3) for a in (rng.randint(0, 20) for _ in range(6))]
    blocks = spark.createDataFrame([(g, i) for g in range(4) for i in range(25)], "g int, index int")
    got = {(r.g, r["index"]): r.n_owners for r in C.owners(blocks, spark.createDataFrame(spans, "g int, start int, end int"), "g").collect()}
    assert got == {(g, i): sum(a <= i < b for h, a, b in spans if h == g) for g in range(4) for i in range(25)}


def test_numbers_and_tables(value, spark):
    agree = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(C.numbers_agree(F.col("a"), F.col("b"))).first()[0]
    assert agree(["1.25", "7%"], ["1.3", "7.2%"]) and not agree(["1.24"], ["1.3"]) and not agree(["1"], ["1", "2"])
    assert value(F.size(tables.projected(tables.cells("x"), F.array(F.lit(0), F.lit(2)))[0]), x="a|b|c\n1|2|3") == 2
    assert value(tables.header_keys(tables.cells("x")), x="a|a\n1|2") is None
    assert value(tables.trailing_heading("x", "y"), x="正文。（二）新的标题", y="正文。") == "（二）新的标题"
    low, high = C.percentage_bounds(*(F.lit(v).cast("decimal(20,6)") for v in ("50", "0.5", "200", "0.5")))
    assert 24.6 < float(value(low, x="")) < 25 < float(value(high, x="")) < 25.4


def test_diagonal_runs_reach_anchors(spark):
    rows = [(0, 5, False), (1, 6, True), (2, 7, False), (4, 9, False), (1, 9, False), (2, 10, False)]
    got = C.extend_on_diagonal(spark.createDataFrame([(1, *r) for r in rows], "doc int, index int, source int, anchor boolean"), ["doc"]).collect()
    assert sorted((r["index"], r.source) for r in got) == [(0, 5), (1, 6), (2, 7)]


def test_overlaps_by_bins(spark):
    rng = random.Random(6)
    row = lambda k: (rng.choice("kkkl"), k, s := rng.randint(-300, 300), s + rng.choice([0, 1, 2, 7, 8, 9, 64, 500, -3]))
    a, b = [row(k) for k in range(150)], [row(k) for k in range(150)] + [(None, 900, 0, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "key string, name long, start long, end long")
    want = sorted((x[0], *x[1:], *y[1:]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    got = C.overlaps(frame(a), frame(b), "key")
    assert got.columns == ["key", "a", "a_start", "a_end", "b", "b_start", "b_end"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    # A hot key: all pairs would be 4e10.
    hot = spark.range(200_000).selectExpr("'k' AS key", "id AS name", "10 * id AS start", "10 * id + 15 AS end")
    assert C.overlaps(hot, hot, "key").where("a < b").count() == 199_999


def test_stops_inside_quotes():
    from quillmesh.functions.similarity import sentence_ends

    cut = lambda t: [t[a:b] for a, b in zip([0, *sentence_ends(t)], sentence_ends(t))]
    assert cut("他说：“好。”然后走了。") == ["他说：“好。”", "然后走了。"]
    assert cut('他说："好。"然后走了。') == ['他说："好。"', "然后走了。"]
    assert cut("见『甲。乙。』一文。完") == ["见『甲。乙。』", "一文。", "完"]
    assert cut("“外「内。」续。”末。") == ["“外「内。」续。”", "末。"]


def test_gram_index_by_brute_force():
    import random

    from quillmesh.functions.similarity import GramIndex, grams_of

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ab公司😀") for _ in range(rng.randint(0, 14)))
    forms = [text() for _ in range(40)]
    index = GramIndex(list(range(40)), forms)
    for _ in range(100):
        probe = text()
        own = set(grams_of(probe))
        want = sorted(((len(own & set(grams_of(f))), k) for k, f in enumerate(forms) if own & set(grams_of(f))), key=lambda x: (-x[0], x[1]))
        assert [(h["hits"], h["source_index"]) for h in index.best(probe, 5)] == want[:5]
        assert [h["source_index"] for h in index.best(probe, None, 0.5)] == [k for n, k in want if 2 * n >= len(own)]


def test_grams_of_wide_characters_and_short_texts_are_exact(spark):
    from quillmesh.functions.similarity import GramIndex, codes_of, grams_of
    from quillmesh.operators import match as M

    texts = ["𠀂𠀂𠀂𠀂𠀂", "甕甕甕甕甕", "😀" * 4, "\ue13f" * 4, "ab", "ab\0\0", "ab\0", "a", "", None, "x😀yz😀x😀yz", "yz😀x", "\uffff\uffff\uffff\uffff", "abcd😀abcd", "发行人𠀂公司", "\0" * 5]
    for text in texts:
        narrow, wide = codes_of(text)
        assert len(narrow) + len(wide) == len(grams_of(text))
    index = GramIndex(list(range(len(texts))), texts)
    want = {}
    for i, t in enumerate(texts):
        own = set(grams_of(t))
        hits = {j: len(own & set(grams_of(s))) for j, s in enumerate(texts)}
        want[i] = {j: h for j, h in hits.items() if h}
        assert {f["source_index"]: f["hits"] for f in index.best(t, None)} == want[i]
        assert all(f["t_size"] == len(own) and f["s_size"] == len(set(grams_of(texts[f["source_index"]]))) for f in index.best(t, None))
    frame = lambda name: spark.createDataFrame([(1, i, "paragraph", t) for i, t in enumerate(texts)], f"doc int, {name} int, kind string, n string")
    for hits in (M._hits_by_index, M._hits_by_join):
        found = {}
        for r in hits(frame("index").where("n IS NOT NULL"), frame("index").where("n IS NOT NULL"), None, 0.0).collect():
            found.setdefault(r["index"], {})[r["source_index"]] = r["hits"]
        assert found == {i: w for i, w in want.items() if w}


def test_weighted_hits_by_index_and_by_join(spark):
    import random

    from quillmesh.operators import match as M

    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    side = lambda n, name: spark.createDataFrame([(k, sorted({rng.choice(words) for _ in range(rng.randrange(9))}) if k else None) for k in range(n)], f"{name} int, grams array<string>")
    t, s = side(40, "target"), side(25, "block")
    rows = [{(r["target"], r["block"]): (round(r["score"], 9), r["rank"]) for r in way(t, s, 4).collect()} for way in (M._weighted_by_index, M._weighted_by_join)]
    assert rows[0] == rows[1] and len(rows[0]) > 60


def test_grams_of_many_texts_at_once():
    """As one by one: repeated, short, wide and empty texts; ties go by key, whatever its place."""
    import random

    from quillmesh.functions.similarity import GramIndex, codes_of

    rng = random.Random(8)
    text = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    forms = [text("abc", rng.randrange(40)) for _ in range(30)] + ["ab", "abc", "", "募集说明书募集", "😀abcd😀abc"]
    texts = [text("abcd", rng.randrange(60)) for _ in range(200)] + ["ab", "", "abc", "募集说明书", "x😀abcd😀", "aaaaaaaa", "\ud800abca"]
    keys = rng.sample(range(1000), len(forms))
    grams = [set(zip(["n"] * len(n), n.tolist())) | set(w) for n, w in map(codes_of, forms)]
    for keep, share in ((None, 0.0), (3, 0.0), (None, 0.5)):
        at, source, hits, size, place = (c.tolist() for c in GramIndex(keys, forms).best_of(texts, keep, share))
        want = []
        for i, t in enumerate(texts):
            narrow, wide = codes_of(t)
            own = set(zip(["n"] * len(narrow), narrow.tolist())) | set(wide)
            found = sorted((-len(own & g), k, j) for j, (k, g) in enumerate(zip(keys, grams)) if own & g and len(own & g) >= share * len(own))
            want += [(i, j, -h, len(own), r) for r, (h, _, j) in enumerate(found[:keep], 1)]
        assert list(zip(at, source, hits, size, place)) == want


def test_subsequences_with_many_forms_at_once_are_those_of_single_pairs():
    import numpy as np

    from quillmesh.functions.similarity import Subsequences, ratio

    rng = random.Random(3)
    forms = [None, "", *("".join(rng.choices("abcd😀é" if k % 3 else "ab", k=rng.choice([1, 7, 8, 9, 63, 200]))) for k in range(60))]
    texts = ["", "a", "zzz", *("".join(rng.choices("abcd😀xé", k=rng.choice([1, 5, 40, 300]))) for _ in range(30))]
    at, form = np.divmod(rng.sample(range(len(texts) * len(forms)), 1500), len(forms))
    for bits in (16, 100, 1 << 16):
        assert Subsequences(forms, bits, held=1000).ratios(texts, at, form).tolist() == [ratio(texts[i], forms[k]) for i, k in zip(at, form)]


def test_literal_by_index_and_by_join(spark):
    from quillmesh.operators import match

    rng = random.Random(4)
    some = lambda n: ["".join(rng.choices("abc", k=rng.choice([2, 4, 9, 30]))) for _ in range(n)]
    targets = spark.createDataFrame([(k % 3, k, "paragraph", n) for k, n in enumerate(some(40))], "doc int, index int, kind string, n string")
    sources = spark.createDataFrame([(k, "paragraph", n) for k, n in enumerate(some(30))], "index int, kind string, n string")
    for within in (2.0, float("inf")):
        a, b = (sorted(map(tuple, f(targets, sources, 7, 0.0, ("kind",), within).collect())) for f in (match._hits_by_index, match._hits_by_join))
        assert a == b and len(a) > 50
