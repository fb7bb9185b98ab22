"""Blocks of web pages: headings and paragraphs by built-in functions, in the form that documents' blocks have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold text of their own, with the level of those that are headings, and the longest heading. A bold start
#: of a paragraph is a heading if it is no longer.
LONGEST = 90
LEVELS = {"h1": 0, "h2": 1, "h3": 2, "h4": 3, "b": 4}
ELEMENT = "<(h1|h2|h3|h4|b|p)(?: [^>]*)?>([^<]*)"


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``doc, index, kind, text, level, heading, is_toc`` of every element of a page that starts with text.

    Entities stay as they are written, scripts and menus are no such elements. A null page has no blocks.
    """
    at = lambda group: F.regexp_extract_all(html_col, F.lit(ELEMENT), F.lit(group))
    found = pages.select(F.col(id_col).alias("doc"), F.posexplode(F.arrays_zip(at(1).alias("tag"), at(2).alias("text"))).alias("index", "e"))
    level = F.when(F.length("e.text") <= LONGEST, F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[F.col("e.tag")])
    return found.select("doc", "index", F.lit("paragraph").alias("kind"), "e.text", level.alias("level"), level.isNotNull().alias("heading"), F.lit(False).alias("is_toc"))
