"""What a table or a paragraph is about, extracted once, and why one may not stand for another.

An identity is a struct that a scan computes once for each unit; the vetoes compare two such structs and need neither
text again. The first veto that holds tells the reason. Words come from a :class:`Descriptors`, so that other documents
can bring their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import tables
from quillmesh.plans import fact_rules as R

SPACE = r"[\t-\r ]*"


@dataclass(frozen=True)
class Descriptors:
    """Words that name what is measured. ``measures``, ``businesses``, ``categories`` and ``scopes``: name to pattern."""

    measures: dict[str, str] = field(default_factory=lambda: R.TABLE_MEASURES)
    leading: dict[str, str] = field(default_factory=lambda: R.LEADING_MEASURES)
    businesses: dict[str, str] = field(default_factory=lambda: R.BUSINESSES)
    categories: dict[str, str] = field(default_factory=lambda: R.PARTIES)
    strict_scopes: tuple[str, ...] = ("发行人本部", "保证人")
    unit_word: str = R.UNIT_WORD


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def names_in(c: Column, named: dict[str, str]) -> Column:
    """Names whose pattern occurs in a text, in the order of ``named``; empty for a null."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(k)) for k, p in named.items())))


def _only(c: Column, named: dict[str, str]) -> Column:
    """The one name that occurs in a text, or empty if none or several do."""
    return _bound(names_in(c, named), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(""))


def scope_at(path: Column, lead: Column | None = None) -> Column:
    """Whose figures stand under a path of headings: the deepest heading that decides; the issuer if none does.

    A heading over both the consolidated and the parent's statements decides nothing, so a deeper one overrides it and
    a higher one is asked next. A text that itself opens with the parent's name goes by that.
    """

    def owner(h: Column) -> Column:
        rule = F.lit(None).cast("string")
        for name, pattern in reversed(R.SCOPE_HEADINGS.items()):
            rule = F.when(h.rlike(pattern), F.lit(name) if name else F.lit(None).cast("string")).otherwise(rule)
        return rule

    told = F.filter(F.transform(F.reverse(F.coalesce(path, F.array().cast("array<string>"))), owner), lambda o: o.isNotNull())
    nearest = F.coalesce(F.get(told, F.lit(0)), F.lit("发行人"))
    return nearest if lead is None else F.when(F.coalesce(lead, F.lit("")).rlike(R.PARENT_LEAD), "发行人本部").otherwise(nearest)


def header_text(matrix: Column, most: int = 3) -> Column:
    """Header rows of a table, at most ``most``: the first row, and those below that hold header words or dates alone."""
    blank_or_header = lambda row: F.forall(row, lambda c: (F.trim(c) == "") | F.trim(c).rlike(R.HEADER_CELL))
    first = F.slice(matrix, 1, most)
    stops = F.filter(F.transform(first, lambda row, i: F.when((i > 0) & ~blank_or_header(row), i)), lambda i: i.isNotNull())
    kept = F.slice(first, 1, F.coalesce(F.get(stops, F.lit(0)), F.size(first)))
    return F.array_join(F.transform(kept, lambda row: F.array_join(row, " ")), "\n")


def table_identity(lines: Column, matrices: Column, path: Column, words: Descriptors = Descriptors()) -> Column:
    """What tables with their captions are about, as a struct.

    ``lines`` are the texts of the caption, unit and other lines of a table's bundle, ``matrices`` its tables
    (``array<array<array<string>>>``), ``path`` the headings above. Fields: ``title, caption, periods, units, scope,
    category, clash, measures, businesses, tables``. Periods come from caption and header, and from the title only if
    those tell none; units from unit lines, else from brackets in the header. ``clash``: caption and header name
    different parties. Nulls are taken as empty.
    """
    none = F.array().cast("array<string>")
    lines, path = F.coalesce(lines, none), F.coalesce(path, none)
    caption = F.array_join(F.filter(lines, lambda x: x.rlike(R.TABLE_CAPTION)), " ")
    heading = F.get(F.filter(F.reverse(path), lambda h: ~h.rlike(R.GENERIC_HEADING) & (F.length(T.strip_lead(h)) > 2)), F.lit(0))
    header = F.coalesce(F.array_join(F.transform(matrices, lambda m: header_text(m)), "\n"), F.lit(""))
    unit_lines = F.filter(lines, lambda x: x.rlike(R.UNIT_LINE))
    said = F.flatten(F.transform(unit_lines, lambda x: F.split(F.trim(F.regexp_replace(x, R.UNIT_LINE, "")), r"[、,，/／\t-\r ]+", -1)))

    def titled(x: Column) -> Column:
        title = F.when(x["caption"] != "", x["caption"]).otherwise(F.coalesce(heading, F.lit("")))
        told = F.array_union(T.periods(x["caption"]), T.periods(x["header"]))
        return F.struct(x["caption"].alias("caption"), x["header"].alias("header"), title.alias("title"), told.alias("told"), said.alias("said"))

    def owned(x: Column) -> Column:
        return x.withField("by_title", _only(x["title"], words.categories)).withField("by_header", _only(F.substring(x["header"], 1, 120), words.categories))

    def told(x: Column) -> Column:
        bracketed = F.filter(F.regexp_extract_all(x["header"], F.lit("[（(]([^（）()]{1,12})[）)]"), F.lit(1)), lambda u: u.rlike(words.unit_word))
        units = F.transform(F.filter(F.when(F.size(x["said"]) > 0, x["said"]).otherwise(bracketed), lambda u: u != ""), lambda u: F.replace(u, F.lit("％"), F.lit("%")))
        return F.struct(
            x["title"].alias("title"),
            x["caption"].alias("caption"),
            F.array_sort(F.when(F.size(x["told"]) > 0, x["told"]).otherwise(T.periods(x["title"]))).alias("periods"),
            F.array_sort(F.array_distinct(units)).alias("units"),
            scope_at(path).alias("scope"),
            F.when(x["by_title"] != "", x["by_title"]).otherwise(x["by_header"]).alias("category"),
            ((x["by_title"] != "") & (x["by_header"] != "") & (x["by_title"] != x["by_header"])).alias("clash"),
            names_in(F.concat(x["title"], F.lit(" "), F.substring(x["header"], 1, 130)), words.measures).alias("measures"),
            names_in(x["title"], words.businesses).alias("businesses"),
            F.coalesce(F.size(matrices), F.lit(0)).alias("tables"),
        )

    first = F.struct(caption.alias("caption"), header.alias("header"))
    return _bound(_bound(_bound(first, titled), owned), told)


def measured(text: Column, words: Descriptors = Descriptors()) -> Column:
    """The leading measured facts of a paragraph: names in the 95 characters before its first verb of amount.

    A paragraph that states no amount measures nothing, whatever words it mentions.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r \x{3000}]+", "")
    lead = F.regexp_extract(plain, f"^(.*?)(?:{R.AMOUNT_VERB})", 1)
    return names_in(F.right(lead, F.lit(95)), words.leading)


def paragraph_identity(text: Column, path: Column, words: Descriptors = Descriptors()) -> Column:
    """What a paragraph is about: ``scope, measures, businesses, company, profile``."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(text, r"[\t-\r \x{3000}]+", "")
    lead = F.right(F.substring_index(plain, "分别", 1), F.lit(85))
    owned = {k: f"(?:{p})[^，。]{{0,12}}业务(?:收入|成本|毛利润|毛利率)" for k, p in words.businesses.items()}
    return F.struct(
        scope_at(path, F.substring(text, 1, 110)).alias("scope"),
        measured(text, words).alias("measures"),
        names_in(lead, owned).alias("businesses"),
        F.regexp_extract(text, R.NAMED_COMPANY, 1).alias("company"),
        F.substring(text, 1, 180).rlike(R.PROFILE).alias("profile"),
    )


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _differ(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def _first(vetoes: list[tuple[Column, str]]) -> Column:
    reason = F.lit("")
    for holds, why in reversed(vetoes):
        reason = F.when(holds, why).otherwise(reason)
    return reason


def _scopes(t: Column, s: Column, words: Descriptors) -> Column:
    return (t["scope"] != s["scope"]) & (t["scope"].isin(*words.strict_scopes) | s["scope"].isin(*words.strict_scopes))


def table_veto(t: Column, s: Column, words: Descriptors = Descriptors()) -> Column:
    """Why a source's table may not replace a target's, or empty: two structs of :func:`table_identity`.

    What only one of them tells vetoes nothing, but for the number of tables.
    """
    return _first([
        (_scopes(t, s, words), "scope"),
        (t["clash"] | s["clash"], "caption against header"),
        (_apart(t["measures"], s["measures"]), "measures"),
        (t["tables"] != s["tables"], "number of tables"),
        (_differ(t["periods"], s["periods"]), "periods"),
        ((t["category"] != "") & (s["category"] != "") & (t["category"] != s["category"]), "parties"),
        (_apart(t["businesses"], s["businesses"]), "businesses"),
        (_differ(t["units"], s["units"]), "units"),
    ])


def paragraph_veto(t: Column, s: Column, words: Descriptors = Descriptors()) -> Column:
    """The same for two structs of :func:`paragraph_identity`."""
    return _first([
        (_scopes(t, s, words), "scope"),
        (_apart(t["businesses"], s["businesses"]), "businesses"),
        (_apart(t["measures"], s["measures"]), "measures"),
        ((t["company"] != "") & (s["company"] != "") & (t["company"] != s["company"]) & (t["profile"] | s["profile"]), "named company"),
    ])


def descriptor_veto(t: Column, s: Column, words: Descriptors = Descriptors()) -> Column:
    """Why a source may not replace a target, or empty: structs with ``text, path, lines, matrices``.

    A target with tables is judged as tables, one without as a paragraph unless the source has tables: then scope alone.
    """
    as_table = lambda x: table_identity(x["lines"], x["matrices"], x["path"], words)
    as_text = lambda x: paragraph_identity(x["text"], x["path"], words)
    has = lambda x: F.coalesce(F.size(x["matrices"]), F.lit(0)) > 0
    mixed = F.when(_scopes(as_text(t), F.struct(scope_at(s["path"]).alias("scope")), words), "scope").otherwise("")
    return F.when(has(t), table_veto(as_table(t), as_table(s), words)).when(has(s), mixed).otherwise(paragraph_veto(as_text(t), as_text(s), words))


def same_table(t: Column, s: Column, words: Descriptors = Descriptors()) -> Column:
    """Whether two identities are one table whose content changed: captions alike, periods and units equal, no veto."""
    key = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\t-\r \x{3000}:：、（）()，,。.]", ""), "发行人|公司", "")
    told = (t["caption"] != "") & (s["caption"] != "") & (F.size(t["periods"]) > 0) & (F.size(s["periods"]) > 0)
    return told & (key(t["caption"]) == key(s["caption"])) & (t["periods"] == s["periods"]) & (t["units"] == s["units"]) & (table_veto(t, s, words) == "")


def matrices_of(text: Column) -> Column:
    """The one table of a block's text, as the array that identities take."""
    return F.array(tables.cells(text))
