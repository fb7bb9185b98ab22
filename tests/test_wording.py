"""Rules that act at once, and ledgers that can be replayed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import wording as W


def plain(text, rules):
    """The same by a plain scan."""
    out, made, at = "", [], 0
    while at < len(text):
        old = next((t for t in sorted(rules, key=lambda t: -len(t)) if text.startswith(t, at)), None)
        if old is None:
            out, at = out + text[at], at + 1
        else:
            made.append((old, rules[old], at))
            out, at = out + rules[old], at + len(old)
    return out, made


def test_against_a_plain_scan(spark):
    rng = random.Random(5)
    rules = {"ab": "b", "abc": "a", "b": "", "c.": "ab😀", "😀": "[x]", "(": ")"}
    texts = ["".join(rng.choice("abc.😀( \n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "ab" * 2000, None]
    frame = spark.createDataFrame([(t, "k") for t in texts], "t string, k string").select("t", W.adapted(F.col("t"), F.col("k"), {"k": rules}).alias("w"))
    for r in frame.select("t", "w", W.replayed(F.col("t"), F.col("w.ledger")).alias("again"), W.first_changes(F.col("w.ledger")).alias("first")).collect():
        want, made = plain(r.t, rules) if r.t is not None else (None, [])
        assert (r.w.text, [tuple(c) for c in r.w.ledger], r.again) == (want, made, want)
        assert [tuple(c) for c in r.first] == list(dict.fromkeys((o, n) for o, n, _ in made))


def test_kinds(spark):
    rows = [
        ("本公司于本核查意见出具之日", "prospectus", "公司于本核查分析文件出具日"),
        ("本公司认为本募集说明书真实", "opinion", "本公司认为募集说明书真实"),
        ("发行人作出承诺：“本公司将偿还”", "opinion", "发行人作出承诺：“公司将偿还”"),
        ("本公司", None, "本公司"),
        ("无", "prospectus", "无"),
    ]
    frame = spark.createDataFrame(rows, "t string, k string, want string").select("want", W.adapted(F.col("t"), F.col("k")).alias("w"))
    assert [(r.want, r.w.text) for r in frame.collect() if r.want != r.w.text] == []
    other = spark.createDataFrame([("a", "x"), ("a", "y")], "t string, k string").select(W.adapted(F.col("t"), F.col("k"), {"x": {"a": "b"}}).alias("w"))
    assert [(r.w.text, len(r.w.ledger)) for r in other.collect()] == [("b", 1), ("a", 0)]
    for bad in ({"": "x"}, {}):
        with pytest.raises(ValueError):
            W.changes(F.col("t"), bad)
    assert re.match(W._pattern({"a.b": ""}), "axb") is None
