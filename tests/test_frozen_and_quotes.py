"""Frozen plans and quotation state against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import quotes
from quillmesh.plans import frozen


def plain_state(texts, pairs):
    stack, out = [], []
    for text in texts:
        before = bool(stack)
        for c in text or "":
            if c in pairs:
                stack.append(pairs[c])
            elif stack and c == stack[-1]:
                stack.pop()
        out.append((len(stack), before or bool(stack)))
    return out


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_quote_state_by_brute_force(spark, stretch):
    rng = random.Random(stretch)
    pairs = {"“": "”", "「": "」", "(": ")", "[": "]"}
    docs = {d: ["".join(rng.choice("“”「」()[]ab ") for _ in range(rng.randrange(6))) or None for _ in range(rng.randrange(1, 40))] for d in "abcdef"}
    frame = spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc string, index int, text string")
    got = {(r["doc"], r["index"]): (r["depth"], r["quoted"]) for r in quotes.quote_state(frame, pairs, stretch).collect()}
    want = {(d, i): s for d, texts in docs.items() for i, s in enumerate(plain_state(texts, pairs))}
    assert got == want and any(depth > 2 for depth, _ in want.values())
    assert quotes.quote_state(frame.limit(0)).count() == 0


def test_a_changed_plan_is_refused(spark, tmp_path):
    rows = [(i, f"text {i}", "accept", None if i % 3 else 1.5) for i in range(20)] + [(0, "text 0", "accept", 1.5)]
    plan = spark.createDataFrame(rows, "index int, new_text string, decision string, score double")
    digest = frozen.table_digest(plan).first()["digest"]
    assert frozen.table_digest(plan.orderBy(F.desc("index")).repartition(5)).first()["digest"] == digest
    assert frozen.table_digest(plan.select("score", "decision", "new_text", "index")).first()["digest"] == digest
    changed = [
        plan.withColumn("decision", F.when(F.col("index") == 7, "pending").otherwise(F.col("decision"))),
        plan.where("index != 7"),
        plan.distinct(),
        plan.union(plan.limit(1)),
        plan.withColumn("score", F.when(F.col("index") == 1, 0.0).otherwise(F.col("score"))),
        plan.limit(0),
    ]
    for k, other in enumerate(changed):
        with pytest.raises(frozen.PlanChanged):
            frozen.write_frozen(other, str(tmp_path / f"refused-{k}"), digest)
    assert list(tmp_path.iterdir()) == []
    frozen.write_frozen(plan.repartition(3), str(tmp_path / "kept"), digest)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 21


def test_canonical_json(spark):
    frame = spark.createDataFrame([("b\n\"", None)], "z string, a int")
    assert frame.select(frozen.canonical_json(frame).alias("j")).first()["j"] == '{"a":null,"z":"b\\n\\""}'
