"""Wording adapted by rules, with a ledger of what was changed where.

All rules act at once on the text as given: no rule sees another's result. At a place the longest term wins, and what it
covers is passed over, so the changes never overlap and the ledger can be replayed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules are one alternation in a generated plan; a pack beyond this isn't a table of wordings.
MOST_RULES = 2000
CHANGE = "struct<old:string,new:string,at:bigint>"

# Terms for the day of a document, and what the documents call themselves, by the kind of document.
DATES = (
    "本募集说明书签署之日", "本募集说明书签署日", "募集说明书签署之日", "募集说明书签署日",
    "本募集说明书出具之日", "本募集说明书出具日", "募集说明书出具之日", "募集说明书出具日",
    "本核查意见出具之日", "本核查意见出具日", "核查意见出具之日", "核查意见出具日",
    "本核查文件出具之日", "本核查文件出具日", "本核查分析文件出具之日",
)
OWN_NAMES = {"本募集说明书": "募集说明书", "本核查意见": "核查意见"}
ISSUER = {"本公司": "公司"}
ISSUER_SPEAKS = "发行人[^。]{0,80}(?:声明|承诺)[：:]?[“「]"


def pack(dates: str = "本核查分析文件出具日") -> dict[str, dict[str, str]]:
    """The rules by kind: a prospectus speaks as the issuer, other papers keep their own first person."""
    common = {**{term: dates for term in DATES}, **OWN_NAMES}
    return {"prospectus": {**common, **ISSUER}, "": common}


def _literal(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def _pattern(rules: Mapping[str, str]) -> str:
    if not rules or "" in rules or len(rules) > MOST_RULES:
        raise ValueError(f"rules: 1 to {MOST_RULES} terms that aren't empty")
    return "|".join(_literal(t) for t in sorted(rules, key=lambda t: (-len(t), t)))


def changes(text: Column, rules: Mapping[str, str]) -> Column:
    """``array<struct<old, new, at>>``: each change that ``rules`` make, in order; ``at`` counts code points of the text
    as given, from 0. A null text has none.

    The places come from the pieces between the terms: the k-th term starts after k + 1 pieces and k terms.
    """
    pattern = _pattern(rules)
    new = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece).cast("long"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{CHANGE}>").alias("made"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        return F.struct((at + F.length(x["old"])).alias("at"), F.array_append(s["made"], F.struct(x["old"].alias("old"), new[x["old"]].alias("new"), at.alias("at"))).alias("made"))

    pairs = F.filter(F.arrays_zip(found.alias("old"), gaps.alias("gap")), lambda x: x["old"].isNotNull())
    return F.coalesce(F.aggregate(pairs, state, step, lambda s: s["made"]), F.array().cast(f"array<{CHANGE}>"))


def replayed(text: Column, ledger: Column) -> Column:
    """The text that a ledger makes of the text it was taken from."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, c: Column) -> Column:
        kept = F.substring(text, (s["at"] + 1).cast("int"), (c["at"] - s["at"]).cast("int"))
        return F.struct(F.concat(s["out"], kept, c["new"]).alias("out"), (c["at"] + F.length(c["old"])).alias("at"))

    return F.aggregate(ledger, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def first_changes(ledger: Column) -> Column:
    """The distinct (old, new) of a ledger in the order of their first places: the mapping that a reader is shown."""
    return F.array_distinct(F.transform(ledger, lambda c: F.struct(c["old"].alias("old"), c["new"].alias("new"))))


def _by_kind(text: Column, kind: Column, packs: Mapping[str, Mapping[str, str]], declares: bool, what, otherwise: Column) -> Column:
    """``what(text, rules)`` of the rules of a row's kind; ``otherwise`` where there are none."""
    chosen = what(text, packs[""]) if packs.get("") else otherwise
    for name, own in packs.items():
        if name and own:
            speaks = F.coalesce(text.rlike(ISSUER_SPEAKS), F.lit(False)) if declares and name == "prospectus" else F.lit(False)
            chosen = F.when(kind.eqNullSafe(F.lit(name)) | speaks, what(text, own)).otherwise(chosen)
    return chosen


def _rewritten(text: Column, rules: Mapping[str, str]) -> Column:
    """The text by all rules at once, from its pieces: one pass, whatever the number of changes."""
    pattern = _pattern(rules)
    new = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("old"))
    return F.array_join(F.transform(pieces, lambda x: F.concat(x["piece"], F.coalesce(F.try_element_at(new, F.coalesce(x["old"], F.lit(""))), F.lit("")))), "")


def adapted(text: Column, kind: Column, rules: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """``struct<text, ledger>`` of a block's text by the rules of its ``kind``; the kind ``""`` is for all others, null too.

    With the default pack, a passage in which the issuer declares something in quotation marks is the issuer's, whatever
    document it is in. A null text gives a null text and an empty ledger. A ledger's time grows with the square of the
    changes in one text, so texts go in as blocks (lines, paragraphs), not as whole documents.
    """
    packs = pack() if rules is None else rules
    ledger = _by_kind(text, kind, packs, rules is None, changes, F.array().cast(f"array<{CHANGE}>"))
    return F.struct(_by_kind(text, kind, packs, rules is None, _rewritten, text).alias("text"), ledger.alias("ledger"))
