"""Scopes, recovery, replaced intervals and whole sections against plain versions."""

import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.similarity import near_texts, ratio
from quillmesh.operators import overlap, recovery, scopes, sections
from quillmesh.plans.store import written
from quillmesh.queries import QUERIES, outlines
from tests.test_queries import SMALLEST

BLOCKS = "doc string, index int, text string, level int, is_toc boolean"


def outline(spark, docs):
    """Documents as lists of texts; a text that begins with n signs # is a heading of level n - 1."""
    rows = []
    for doc, texts in docs.items():
        for i, text in enumerate(texts):
            n = len(text) - len(text.lstrip("#"))
            rows.append((doc, i, text.lstrip("#"), n - 1 if n else None, False))
    return written(scopes.outlined(spark.createDataFrame(rows, BLOCKS).withColumn("heading", F.col("level").isNotNull())), "outline")


LONG = ["the first paragraph that is unlike any other", "a second paragraph of some length as well", "the third one stands here, rather long too", "number four is not short in the least"]


def test_catalogue_of_nested_scopes(spark):
    rows = scopes.scope_catalogue(outline(spark, {"d": ["", "#Annual report", "intro", "##Revenue of the year", "up", "", "##Costs of the year", "###Staff costs", "down", "#Empty", "", "#Last words here", "end"]})).collect()
    got = {r["title"]: (r["start"], r["end"], r["leaf"], r["body"], r["outside"]) for r in rows}
    assert got == {
        "Annual report": (2, 9, False, "introRevenueoftheyearupCostsoftheyearStaffcostsdown", []),
        "Revenue of the year": (4, 5, True, "up", ["annualreport"]),
        "Costs of the year": (7, 9, False, "Staffcostsdown", ["annualreport"]),
        "Staff costs": (8, 9, True, "down", ["annualreport", "costsoftheyear"]),
        "Last words here": (12, 13, True, "end", []),
    }


def test_longest_chain_by_brute_force(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(12) for _ in range(rng.randrange(0, 15))],) for _ in range(150)]
    for r in spark.createDataFrame(rows, "p array<int>").select("p", scopes.longest_chain(F.col("p")).alias("n")).collect():
        ends = []
        for x in r["p"]:
            at = bisect.bisect_left(ends, x)
            ends[at : at + 1] = [x]
        assert r["n"] == len(ends)


def reconciled(spark, targets, sources, **options):
    t, s = outline(spark, targets), outline(spark, sources)
    return {(r["doc"], r["at"]): r for r in scopes.reconcile_scopes(scopes.scope_catalogue(t), scopes.scope_catalogue(s), scopes.unique_anchors(t, s), **options).collect()}


def test_renamed_scopes_need_anchors_in_order(spark):
    target = {"t": ["#Overview of the firm", *LONG[:3]]}
    source = lambda *order: {"s": ["#Firm profile", *(LONG[k] for k in order), "more"]}
    row = reconciled(spark, target, source(0, 1, 2))["t", 0]
    assert (row["source_at"], row["source_start"], row["source_end"], row["renamed"], row["same"], row["status"]) == (0, 1, 5, True, False, "auto")
    assert not reconciled(spark, target, source(1, 0, 2))  # crossing anchors
    assert reconciled(spark, target, source(1, 0, 2), all_in_order=False)["t", 0]["renamed"]
    assert not reconciled(spark, target, source(2, 1, 0), all_in_order=False)  # no chain of two
    assert not reconciled(spark, target, source(0))  # one anchor


def test_scopes_by_heading_and_versions(spark):
    target = {"t": ["#Part of the report", "##Risk factors", LONG[0], "old words", "##Outlook for us", "own text"]}
    source = {
        "a": ["#Part of the report", "##Risk factors", LONG[0], "new words", "##Outlook for us", "one"],
        "b": ["#Another part", "##Risk factors", "quite other words"],
        "c": ["#Part of the report", "##Outlook for us", "two"],
        "d": ["#Part of the report", "##Outlook for us", "one"],
        "e": ["#Part of the report", "##Outlook for us", "one more"],
    }
    got = reconciled(spark, target, source)
    assert (got["t", 1]["source_doc"], got["t", 1]["n_versions"], got["t", 1]["status"]) == ("a", 1, "auto")
    assert (got["t", 4]["source_doc"], got["t", 4]["n_versions"], got["t", 4]["n_docs"], got["t", 4]["status"]) == ("a", 3, 2, "auto")
    undecided = reconciled(spark, target, {k: source[k] for k in "ace"})["t", 4]
    assert (undecided["n_versions"], undecided["status"], undecided["source_doc"]) == (3, "review", "a")
    led = reconciled(spark, target, {k: source[k] for k in "ace"}, leading=F.col("source_doc") == "c")["t", 4]
    assert (led["source_doc"], led["n_versions"], led["status"]) == ("c", 1, "auto")


def test_a_scope_split_among_headings_is_no_candidate(spark):
    target = {"t": ["#Profile of it", LONG[0], LONG[1], "#History of it", LONG[2]]}
    assert not reconciled(spark, target, {"s": ["#Profile and history", LONG[0], LONG[1], LONG[2]]})


def test_recovery_goes_on_from_what_it_finds(spark):
    same = ["alpha", "beta", "gamma", "delta"]
    t = outline(spark, {"t": ["#Risk factors here", LONG[0], *same, "own", "beta", "#A heading in common", "after it"]})
    s = outline(spark, {"s": ["#Risk factors here", LONG[0], *same, "else", "#Other", "beta"], "r": ["#Risk factors here", "alpha", LONG[1], "#A heading in common", "after it"]})
    start = spark.createDataFrame([("t", 1, "s", 1)], "doc string, index int, source_doc string, source_index int")
    got = sorted(tuple(r) for r in recovery.recover_coverage(t, s, start).collect())
    assert got == [("t", 1, "s", 1, 0), *(("t", k, "s", k, k - 1) for k in range(2, 6))]
    # two sources at once: the block stays open, and nothing goes on from it
    start = spark.createDataFrame([("t", 1, "s", 1), ("t", 3, "r", 2)], start.schema)
    assert ("t", 2) not in {tuple(r)[:2] for r in recovery.recover_coverage(t, s, start).collect()}
    none = recovery.recover_coverage(t, s, start, eligible=F.lit(False))
    assert none.count() == 2


def test_recovery_over_a_heading_that_both_have(spark):
    docs = lambda name, last: {name: ["#Risk factors here", LONG[0], "#A heading in common", "after it", last]}
    start = spark.createDataFrame([("t", 1, "s", 1)], "doc string, index int, source_doc string, source_index int")
    got = sorted(tuple(r) for r in recovery.recover_coverage(outline(spark, docs("t", "x")), outline(spark, docs("s", "y")), start).collect())
    assert got == [("t", 1, "s", 1, 0), ("t", 3, "s", 3, 1)]


def plain_kept(rows):
    kept, out = [], {}
    for k, name, s, e, strength in sorted(rows, key=lambda r: (r[4], r[1])):
        hit = next((x for x in kept if k is not None and x[0] == k and x[2] < x[3] and s < e and x[2] < e and s < x[3]), None)
        if hit is None:
            kept.append((k, name, s, e))
        out[name] = (hit is None, hit and hit[1], bool(hit and (s < hit[2] or e > hit[3])))
    return out


@pytest.mark.parametrize("ordered", [False, True])
def test_replaced_intervals_by_brute_force(spark, ordered):
    rng = random.Random(9)
    rows = []
    for name in range(260):
        s = rng.randrange(300)
        rows.append((rng.choice(["x", "y", "x", None]), name, s, s + rng.choice([0, 3, 12, 40]), s if ordered else rng.randrange(4)))
    frame = spark.createDataFrame(rows, "k string, name int, start int, end int, w int")
    got = {r["name"]: (r["kept"], r["replaced_by"], r["crossing"]) for r in overlap.replace_overlapping(frame, "k", F.col("w")).collect()}
    assert got == plain_kept(rows) and 40 < sum(v[0] for v in got.values()) < 240
    assert overlap.replace_overlapping(frame.limit(0), "k", F.col("w")).count() == 0


def test_near_keys_by_brute_force(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcdef治理结构") for _ in range(n)) for n in (2, 3, 5, 8, 12, 17, 25, 40) for _ in range(4)]
    keys = set(stems)
    for stem in stems:
        for _ in range(6):
            w = list(stem)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
            keys.add("".join(w))
    keys = sorted(keys)
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r["key"], r["s_key"]) for r in sections.near_keys(frame, frame).collect()}
    want = {(a, b) for a in keys for b in keys if a != b and len(a) > 1 and len(b) > 1 and ratio(a, b) >= 0.88}
    assert got == want and len(want) > 40


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the driver's tables")
def test_complete_sections_by_brute_force(spark):
    targets, sources = (sections.heading_sections(written(side, "outline")).collect() for side in outlines(spark, SMALLEST))

    def scores(a, b):
        if not a or not b:
            return (1.0, 1.0) if not a and not b else (0.0, 0.0)
        return max(ratio(x, y) for x in a for y in b), ratio(a[-1], b[-1])

    want = {}
    for t in targets:
        found = []
        for s in sources:
            leaf = 1.0 if t["key"] == s["key"] else ratio(t["key"], s["key"])
            parent, direct = scores(t["parents"], s["parents"])
            if leaf < 0.88 or len(t["key"]) < 8 and direct < 0.9 or parent < 0.68 or direct < 0.72:
                continue
            verified = t["key"] == s["key"] and parent >= 0.92 and direct >= 0.86
            found.append((not verified, -round(direct, 4), -round(0.72 * leaf + 0.28 * parent, 4), s["doc"], s["at"], s["body"]))
        seen, top = set(), []
        for f in sorted(found):
            if (f[3], f[5]) not in seen:
                seen.add((f[3], f[5]))
                top.append(f)
        if top := top[:4]:
            sure = [f for f in top if not f[0]]
            shown = (sure or top)[0]
            want[t["doc"], t["at"]] = (shown[3], shown[4], shown[5] == t["body"], len(top), "auto" if len({f[5] for f in sure}) == 1 else "review")
    rows = QUERIES["complete_sections"](spark, SMALLEST).collect()
    assert {(r["doc"], r["at"]): (r["source_doc"], r["source_at"], r["same"], r["n_candidates"], r["status"]) for r in rows} == want and want


def test_near_keys_make_no_cross_product(spark):
    frame = spark.createDataFrame([("abc",)], "key string")
    plan = sections.near_keys(frame, frame)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def most_rows(df):
    """The most rows that any step of a query put out, and its result."""

    def walk(node):
        name, metrics, children = node.nodeName(), node.metrics(), node.children()
        if metrics.contains("numOutputRows"):
            yield metrics.apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in name:
            yield from walk(node.executedPlan())
        elif "QueryStage" in name:
            yield from walk(node.plan())
        for i in range(children.size()):
            yield from walk(children.apply(i))

    rows = df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan())), rows


def test_sections_of_one_heading_are_not_paired_one_by_one(spark):
    some = "doc string, at int, key string, parents array<string>, body string"
    both = [spark.createDataFrame([(f"{side}{i:03}", 0, "summary of results", ["the year"], f"body {i % 300}") for i in range(900)], some) for side in "ts"]
    most, rows = most_rows(sections.complete_sections(*both))
    assert most < 9000 and len(rows) == 3600
    first = sorted((r["doc"], r["source_doc"], r["same"], r["rank"]) for r in rows if r["doc"] in ("t000", "t302"))
    assert first == [("t000", f"s00{k}", k == 0, k + 1) for k in range(4)] + [("t302", f"s00{k}", k == 2, k + 1) for k in range(4)]


def test_a_body_is_a_candidate_once_under_several_headings(spark):
    some = "doc string, at int, key string, parents array<string>, body string"
    targets = spark.createDataFrame([("t", 0, "summary of results", [], "x")], some)
    rows = [("s", k, key, [], body) for k, (key, body) in enumerate([("summary of result", "x"), ("summary of results", "x"), ("summary of results", "y"), ("summary of resultss", "z"), ("summary of results", "y")])]
    got = {(r["source_at"], r["rank"], r["exact"], r["same"]) for r in sections.complete_sections(targets, spark.createDataFrame(rows, some)).collect()}
    assert got == {(1, 1, True, True), (2, 2, True, False), (3, 3, False, False)}


def test_near_texts_by_brute_force_across_lengths():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdef治理\U00020000") for _ in range(n)) for n in (2, 3, 9, 17, 40, 90) for _ in range(4)]
    keys = set(stems) | {"a" * n for n in range(2, 30)}
    for stem in stems:
        for _ in range(8):
            w = list(stem)
            for _ in range(rng.randrange(1, 8)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
            keys.add("".join(w))
    keys = sorted(k for k in keys if len(k) > 1)
    for least in (0.7, 0.88):
        got = near_texts(keys, keys, least, width=64, rows=16)
        assert len(got) == len(set(got)) and {g[:2] for g in got} == {(a, b) for a in keys for b in keys if a != b and ratio(a, b) >= least}


def test_leaves_of_one_heading_are_not_paired_one_by_one(spark):
    docs = lambda side: {f"{side}{i:03}": ["#Annual report", "##Summary of results", f"body {i % 200}"] for i in range(600)}
    t, s = outline(spark, docs("t")), outline(spark, docs("s"))
    most, rows = most_rows(scopes.reconcile_scopes(scopes.scope_catalogue(t), scopes.scope_catalogue(s), scopes.unique_anchors(t, s)))
    assert most < 6000 and len(rows) == 600
    assert all((r["source_doc"], r["same"], r["n_versions"], r["n_docs"], r["status"]) == (f"s{int(r['doc'][1:]) % 200:03}", True, 200, 3, "auto") for r in rows)


def test_listed_candidates_are_those_of_each_leaf_by_itself(spark):
    rng = random.Random(4)
    shared = [f"a paragraph that several documents share, number {k}" for k in range(6)]

    def docs(side, n):
        out = {}
        for i in range(n):
            texts = [f"#{rng.choice(['Annual report', 'Interim report'])}"]
            for _ in range(rng.randrange(1, 4)):
                texts.append("##" + rng.choice(["Summary of results", "Summary of results", "Risks of all kinds"]))
                texts += rng.choice([shared[:1], shared[:2], shared[:3], rng.sample(shared, 2)])
                if rng.random() < 0.5:
                    texts.append(f"a paragraph of one source alone, number {rng.randrange(2 * n)}")
            out[f"{side}{i}"] = texts
        return out

    t, s = outline(spark, docs("t", 50)), outline(spark, docs("s", 50))
    args = [scopes.scope_catalogue(t), scopes.scope_catalogue(s), scopes.unique_anchors(t, s)]
    listed, each = (sorted(map(tuple, scopes.reconcile_scopes(*args, leading=leading).collect())) for leading in (None, F.lit(False)))
    assert listed == each and len(listed) > 60 and len({r[-1] for r in listed}) == 2 and len(args[2].take(9)) == 9


@pytest.mark.parametrize("ordered", [False, True])
def test_replaced_intervals_over_many_slices(spark, monkeypatch, ordered):
    monkeypatch.setattr(overlap, "SLICE", 8)
    monkeypatch.setattr(overlap, "GROWTH", 2)
    monkeypatch.setattr(overlap, "LENGTHS", 1)
    rng = random.Random(3)
    rows = []
    for name in range(400):
        s = rng.randrange(600)
        rows.append((rng.choice(["x", "y", None]), name, s, s + rng.choice([0, 3, 9, 200]), s if ordered else rng.randrange(5)))
    frame = spark.createDataFrame(rows, "k string, name int, start int, end int, w int")
    got = {r["name"]: (r["kept"], r["replaced_by"], r["crossing"]) for r in overlap.replace_overlapping(frame, "k", F.col("w")).collect()}
    assert got == plain_kept(rows)


def test_replaced_intervals_are_not_paired(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs of intervals")

    monkeypatch.setattr(overlap, "overlaps", refuse)
    frame = spark.range(1500).select(F.lit("x").alias("k"), F.col("id").alias("name"), F.col("id").alias("start"), (F.col("id") + 2000).alias("end"))
    rows = overlap.replace_overlapping(frame, "k", F.col("name")).collect()
    assert all((r["kept"], r["replaced_by"], r["crossing"]) == ((True, None, False) if r["name"] == 0 else (False, 0, True)) for r in rows)
