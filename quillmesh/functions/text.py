"""Normal forms of texts as column expressions. Patterns are explicit about white space: Java and Python differ in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.plans import rules as R


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _any(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _replaced(text: Column, words, by: str, signs) -> Column:
    """``text`` with ``words`` replaced; most texts have none of the ``signs``, one of which is in each word."""
    some = F.lit(False)
    for sign in signs:
        some = some | F.contains(text, F.lit(sign))
    return F.when(some, F.regexp_replace(text, _any(words), by)).otherwise(text)


def compact(c) -> Column:
    """Without white space, six full-width marks as ASCII: one pass over the characters."""
    return F.translate(_text(c), "（），。：；" + R.WHITE, "(),.:;")


def neutral(c) -> Column:
    """The identity of a fact: own dates, voice words and spacing do not count."""
    dated = _replaced(_text(c), R.DATE_TERMS, "<DATE>", R.DATE_WORDS)
    named = F.replace(dated, F.lit(R.THIS_SOURCE), F.lit(R.SOURCE))
    return compact(_replaced(named, [*R.ISSUER_WORDS, R.COMPANY], "<C>", [R.ISSUER_WORDS[0], R.COMPANY]))


def lead(c) -> Column:
    """The numbering shell in front of a text, empty if there is none."""
    return F.regexp_extract(_text(c), R.LEAD, 0)


def after_lead(c) -> Column:
    return F.regexp_replace(_text(c), R.LEAD, "")


def lead_token(c) -> Column:
    return compact(lead(c))


def strip_lead(c) -> Column:
    """Without chapter marks and dotted numbers, too."""
    return F.trim(F.regexp_replace(_text(c), R.LONG_LEAD, ""))


def adapt(c) -> Column:
    """A source text in the voice of the issuer's own document."""
    dated = _replaced(_text(c), R.DATE_TERMS, R.OWN_DATE, R.DATE_WORDS)
    named = F.replace(dated, F.lit(R.THIS_SOURCE), F.lit(R.SOURCE))
    return _replaced(named, R.ISSUER_WORDS, R.COMPANY, R.ISSUER_WORDS)


def adapt_for(source, target) -> Column:
    """:func:`adapt`, with the target's numbering in place of a numbering that differs."""
    text = adapt(source)
    own = lead(text)
    return F.when((own != "") & (own != lead(target)), F.concat(lead(target), after_lead(text))).otherwise(text)


def projection_normal(c, mask: bool = False) -> Column:
    """Without dates, voice words and punctuation; with ``mask``, percentages are alike."""
    text = F.regexp_replace(_text(c), R.SELF_DATE, "")
    text = F.regexp_replace(text, _any([*R.ISSUER_WORDS, R.COMPANY]), "")
    if mask:
        text = F.regexp_replace(text, R.PERCENTAGE, "<P>")
    return F.regexp_replace(text, R.PUNCTUATION, "")


def percentages(c) -> Column:
    """Percentages of a text in order, as written."""
    return F.regexp_extract_all(_text(c), F.lit(R.PERCENTAGE), F.lit(0))


def clauses(c) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(R.CLAUSE), F.lit(0))


def segment_key(c) -> Column:
    """A clause's identity, without the marks at its end."""
    return neutral(F.regexp_replace(_text(c), r"[。；;]+[\t-\r ]*$", ""))


def headingish(c) -> Column:
    text = F.trim(_text(c))
    return (F.length(text) < 90) & text.rlike(R.HEADING_START)


def substantive(c) -> Column:
    """Whether a text set as a heading states a fact: it has a fact word or ends like a sentence."""
    text = F.trim(_text(c))
    return text.rlike(_any(R.FACT_WORDS)) | text.rlike(f"[{''.join(R.FACT_ENDS)}]$")


def structural_heading(c, heading: Column | None = None) -> Column:
    shaped = headingish(c) if heading is None else heading | headingish(c)
    return shaped & ~substantive(c)


def heading_level(c) -> Column:
    """Level by the numbering alone, null for what is no heading."""
    text = _text(c)
    level = F.lit(None).cast("int")
    for number, pattern, most in reversed(R.HEADING_LEVELS):
        level = F.when(text.rlike(pattern) & (F.length(text) <= most), F.lit(number)).otherwise(level)
    plain = (text == "") | (F.length(text) > 160) | text.rlike("[。；;]$") | text.rlike(R.NOT_HEADING)
    return F.when(~plain, level)


def visible_equal(a, b) -> Column:
    return compact(a) == compact(b)


def stable_id(name, target_index, source_index, text) -> Column:
    """20 hex digits over the place of a proposal and the start of its text."""
    joined = F.concat_ws("|", name, target_index.cast("string"), source_index.cast("string"), F.substring(compact(text), 1, 180))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 20)


def row_key(c) -> Column:
    """A table label without numbering, spacing, marks and remarks in brackets."""
    return F.regexp_replace(F.regexp_replace(compact(strip_lead(c)), r"[(（][^)）]*[)）]", ""), r"[:,.;、]", "")


def title_key(c) -> Column:
    """A heading without numbering, spacing and marks."""
    return F.lower(F.regexp_replace(strip_lead(c), r"[\t-\r \x{3000}\x{a0}，。；：、“”‘’（）()《》:;,.\-—]+", ""))


def skeleton(c) -> Column:
    """Digits alike, and nothing but letters, ideographs and that sign."""
    digits = F.regexp_replace(F.lower(_text(c)), r"[0-9]+(?:[.,][0-9]+)*", "#")
    return F.regexp_replace(digits, r"[^a-z#\x{4e00}-\x{9fff}]+", "")


def evidence_numbers(c) -> Column:
    """Signed numbers with an optional percent sign, in order, without digit grouping."""
    found = F.regexp_extract_all(_text(c), F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", ""))


def periods(c) -> Column:
    """Distinct periods in order: ``YYYY`` or ``YYYY-MM``; a range of years is spread over at most six."""
    pattern = r"((?:19|20)[0-9]{2})[\t-\r ]*(?:年度?)?[\t-\r ]*(?:[-－—–至]|到)[\t-\r ]*((?:19|20)[0-9]{2})[\t-\r ]*年|((?:19|20)[0-9]{2})[\t-\r ]*年(?:[\t-\r ]*(?:[0-9]{1,2}[\t-\r ]*[-－—–至][\t-\r ]*)?([0-9]{1,2})[\t-\r ]*月)?"
    found = F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0))

    def spread(m: Column) -> Column:
        first, last = F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)
        year, month = F.regexp_extract(m, pattern, 3), F.regexp_extract(m, pattern, 4)
        begin = first.try_cast("int")
        end = F.least(last.try_cast("int"), begin + 5)
        years = F.when(end >= begin, F.transform(F.sequence(begin, end), lambda y: y.cast("string"))).otherwise(F.array(first))
        one = F.when(month == "", year).otherwise(F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))
        return F.when(first != "", years).otherwise(F.array(one))

    return F.array_distinct(F.flatten(F.transform(found, spread)))


def decimal(c) -> Column:
    """A number as written, as an exact decimal; null if it is none."""
    plain = F.regexp_replace(F.translate(_text(c), "－−—,，", "---"), R.SPACE, "")
    return F.regexp_replace(plain, "%$", "").try_cast("decimal(38,12)")


def shown_tolerance(c) -> Column:
    """Half a unit in the last place that a number shows."""
    places = F.length(F.regexp_extract(_text(c), r"\.([0-9]+)", 1))
    return (F.lit("0.5").cast("decimal(38,12)") / F.pow(F.lit(10.0), places).cast("decimal(20,0)")).cast("decimal(38,12)")


def safe_name(c) -> Column:
    return F.substring(F.regexp_replace(_text(c), r'[\\/:*?"<>|\x00-\x1f]+', "_"), 1, 180)
