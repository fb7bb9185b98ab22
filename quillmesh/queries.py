"""Queries over the driver's tables, one for each operator or family of operators, and the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import similarity as S
from quillmesh.functions import text as T
from quillmesh.functions import wording
from quillmesh.operators import blocks as B
from quillmesh.operators import match as M
from quillmesh.operators import reconcile as C
from quillmesh.operators import guards, overlap, quotes, recovery, resolve, scopes, sections, tables
from quillmesh.plans import frozen
from quillmesh.plans import rules as R
from quillmesh.plans.analyze import analyze
from quillmesh.plans.store import written
from quillmesh.sources import pages as P
from quillmesh.sources import uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines name the same types."""
    return df.select(*(F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))


_PARAGRAPHS = r"""p AS (SELECT doc_id AS doc, generate_subscripts(l, 1) - 1 AS index, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
_DATES = "|".join(sorted(R.DATE_TERMS, key=lambda w: (-len(w), w)))


def _compact(x: str) -> str:
    return f"translate(regexp_replace({x}, '{SPACES}', '', 'g'), '（），。：；', '(),.:;')"


def _neutral(x: str) -> str:
    return _compact(f"regexp_replace(replace(regexp_replace({x}, '{_DATES}', '<DATE>', 'g'), '本募集说明书', '募集说明书'), '发行人|本公司|公司', '<C>', 'g')")


_GRAMS = "CASE WHEN n = '' THEN []::VARCHAR[] WHEN length(n) < 4 THEN [n] ELSE list_distinct(list_transform(range(1, length(n) - 2), lambda i: n[i:i + 3])) END"
_SIDES = f"""{_PARAGRAPHS},
t AS (SELECT doc, index, text, {_neutral("text")} AS n FROM p),
s AS (SELECT item_id, text, {_neutral("coalesce(text, '')")} AS n FROM benchmark),
tg AS MATERIALIZED (SELECT doc, index, {_GRAMS} AS g FROM t WHERE n != ''),
sg AS MATERIALIZED (SELECT item_id, {_GRAMS} AS g FROM s WHERE length(n) >= 4),
h AS MATERIALIZED (SELECT doc, index, item_id, count(*) AS hits, any_value(tn) AS tn, any_value(sn) AS sn FROM
  (SELECT doc, index, len(g) AS tn, unnest(g) AS gram FROM tg) JOIN (SELECT item_id, len(g) AS sn, unnest(g) AS gram FROM sg) USING (gram) GROUP BY doc, index, item_id)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as targets, benchmark items as the blocks of one source."""
    targets = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n", T.neutral("text"))
    items = table(spark, sf_dir, "benchmark")
    sources = items.select(F.col("item_id").alias("index"), F.lit("paragraph").alias("kind"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", T.neutral("text"))
    return targets.where("n != ''"), sources.where(F.length("n") >= 4)


@query(f"WITH {_PARAGRAPHS} SELECT doc, index::BIGINT AS index, text, length(text)::BIGINT AS n_chars FROM p")
def blocks_split(spark, sf_dir):
    return longs(B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc", "index", "text", F.length("text").alias("n_chars")))


@query(f"""SELECT conv_id, turn, {_compact("text")} AS compact, {_neutral("text")} AS neutral,
  regexp_replace(regexp_replace(lower(text), '[0-9]+(?:[.,][0-9]+)*', '#', 'g'), '[^a-z#\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS skeleton FROM conversations""")
def normal_forms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.compact("text").alias("compact"), T.neutral("text").alias("neutral"), T.skeleton("text").alias("skeleton"))


@query(f"""WITH {_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, index ORDER BY hits DESC, item_id) AS place FROM h)
SELECT doc, index::BIGINT AS index, item_id, hits::BIGINT AS hits, round(hits / (tn + sn - hits), 9) AS jaccard, place::BIGINT AS place FROM r WHERE place <= 8""")
def gram_topk(spark, sf_dir):
    hits = M.gram_hits(*sides(spark, sf_dir), keep=8).withColumn("jaccard", F.round(M.jaccard(), 9))
    return longs(hits.select("doc", "index", F.col("source_index").alias("item_id"), "hits", "jaccard", "place"))


@query(f"""WITH {_SIDES}, e AS (SELECT doc, index, item_id, row_number() OVER (PARTITION BY doc, index ORDER BY item_id) AS r FROM t JOIN s USING (n) WHERE n != '' AND length(n) >= 4),
f AS (SELECT *, row_number() OVER (PARTITION BY doc, index ORDER BY hits DESC, item_id) AS r FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = h.doc AND e.index = h.index))
SELECT doc, index::BIGINT AS index, item_id, 'exact' AS branch FROM e WHERE r <= 8 UNION ALL SELECT doc, index::BIGINT, item_id, 'fuzzy' FROM f WHERE r = 1""")
def exact_then_fuzzy(spark, sf_dir):
    targets, sources = sides(spark, sf_dir)
    exact = M.exact_candidates(targets, sources)
    rest = targets.join(sources.select("kind", "n").distinct(), ["kind", "n"], "left_anti")  # without an exact candidate
    fuzzy = M.gram_hits(rest, sources, keep=1)
    pick = lambda df, branch: df.select("doc", "index", F.col("source_index").alias("item_id"), F.lit(branch).alias("branch"))
    return longs(pick(exact, "exact").unionAll(pick(fuzzy, "fuzzy")))


@query(f"""WITH {_SIDES} SELECT doc, index::BIGINT AS index, item_id, round(hits / tn, 9) AS coverage FROM h WHERE hits >= 0.82 * tn AND tn >= 8""")
def containment_coverage(spark, sf_dir):
    hits = M.gram_hits(*sides(spark, sf_dir), keep=None, share=0.82).where("t_size >= 8")
    return longs(hits.select("doc", "index", F.col("source_index").alias("item_id"), F.round(F.col("hits") / F.col("t_size"), 9).alias("coverage")))


@query("""SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY sha256(text)""")
def dedupe_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("seq"), F.lit(0).alias("part"), F.col("text").cast("binary").alias("content"))
    return uploads.first_copies(files).select(F.col("doc").alias("sha"), F.col("seq").alias("first_doc"), F.col("n_copies").alias("copies"))


@query("""SELECT conv_id, turn,
  last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations""")
def anchor_prev_next(spark, sf_dir):
    return B.nearest_marked(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.col("turn")).select("conv_id", "turn", "before", "after")


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem),
b AS (SELECT *, coalesce((i - lag(i) OVER w != 1)::INT, 1) AS brk FROM x WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k AS l_orderkey, i::BIGINT AS l_linenumber, (sum(brk) OVER (PARTITION BY k ORDER BY i, brk ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM b""")
def diagonal_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return longs(B.islands(lines, ["l_orderkey"], "l_linenumber"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS r, o_totalprice - lead(o_totalprice) OVER w AS margin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, round(margin, 4) AS margin FROM r WHERE r = 1""")
def margin_top2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return C.margin_top(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", F.round("margin", 4).alias("margin"))


@query("""WITH i AS (SELECT c_nationkey AS k, c_custkey AS s, c_custkey + 40 AS e FROM customer)
SELECT c_nationkey, c_custkey, (SELECT count(*) FROM i WHERE k = c_nationkey AND s <= c_custkey AND c_custkey < e)::BIGINT AS n_owners FROM customer""")
def interval_owner(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    intervals = people.select("c_nationkey", F.col("c_custkey").alias("start"), (F.col("c_custkey") + 40).alias("end"))
    return longs(C.owners(people.select("c_nationkey", "c_custkey"), intervals, "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey", "n_owners"))


@query("""SELECT a.c_nationkey, a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey
  AND a.c_custkey < b.c_custkey AND a.c_custkey < b.c_custkey + 40 AND b.c_custkey < a.c_custkey + 40""")
def interval_overlap(spark, sf_dir):
    i = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("name"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 40).alias("end"))
    return C.overlaps(i, i, "c_nationkey").where("a < b").select("c_nationkey", "a", "b")


@query(f"""WITH {_SIDES} SELECT doc, index::BIGINT AS index FROM t WHERE n != '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.n = t.n AND length(s.n) >= 4)""")
def uncovered_blocks(spark, sf_dir):
    targets, sources = sides(spark, sf_dir)
    return longs(C.uncovered(targets, sources, ["n"]).select("doc", "index"))


@query("""WITH f AS (SELECT l_partkey, l_orderkey, l_linenumber, l_discount::DECIMAL(38,12) AS v FROM lineitem),
g AS (SELECT l_partkey, min_by(v, (l_orderkey, l_linenumber, v)) AS v0 FROM f GROUP BY l_partkey)
SELECT l_partkey, count(*)::BIGINT AS n_facts, bool_or(abs(v - v0) > 0.05) AS conflict FROM f JOIN g USING (l_partkey) GROUP BY l_partkey""")
def tolerance_conflict(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_discount").cast("decimal(38,12)").alias("value"), F.lit("0.05").cast("decimal(38,12)").alias("tolerance"))
    return C.conflicts(facts, ["l_partkey"], ["l_orderkey", "l_linenumber", "value"])


@query("""WITH t AS (SELECT o_orderkey, round(o_totalprice, 2)::DECIMAL(38,12) AS v FROM orders),
s AS (SELECT l_orderkey, sum(round(l_extendedprice, 2)::DECIMAL(38,12)) AS v FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN s.v IS NULL THEN 'unknown' WHEN abs(t.v - s.v) <= 1000 THEN 'match' ELSE 'differs' END AS verdict FROM t LEFT JOIN s ON o_orderkey = l_orderkey""")
def fact_target_check(spark, sf_dir):
    exact = lambda c: F.round(c, 2).cast("decimal(38,12)")
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), exact("o_totalprice").alias("value"), F.lit(0).cast("decimal(38,12)").alias("tolerance"))
    sources = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.round("l_extendedprice", 2).cast("decimal(24,12)")).cast("decimal(38,12)").alias("value")).withColumn("tolerance", F.lit(1000).cast("decimal(38,12)"))
    return C.target_checks(targets, sources, ["key"]).select(F.col("key").alias("o_orderkey"), "verdict")


@query("""WITH s AS (SELECT s_nationkey::BIGINT AS parent, floor(s_acctbal / 100)::BIGINT AS key, min(s_suppkey) AS pos FROM supplier GROUP BY ALL), t AS (SELECT DISTINCT c_nationkey AS parent, floor(c_acctbal / 100)::BIGINT AS key FROM customer),
m AS (SELECT s.*, t.key IS NOT NULL AS ok FROM s LEFT JOIN t ON s.parent = t.parent AND s.key = t.key),
p AS (SELECT *, last_value(CASE WHEN ok THEN key END IGNORE NULLS) OVER (PARTITION BY parent ORDER BY pos, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN ok THEN key END IGNORE NULLS) OVER (PARTITION BY parent ORDER BY pos, key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  count(*) OVER (PARTITION BY parent) AS n, sum(ok::INT) OVER (PARTITION BY parent) AS have FROM m)
SELECT parent, key, pos, before, after FROM p WHERE NOT ok AND have > 0 AND have >= least(CASE WHEN n < 3 THEN n - 1 ELSE greatest(3, ceil(n * 3 / 5)) END, n - 1)""")
def missing_siblings(spark, sf_dir):
    items = lambda name, x, *keep: table(spark, sf_dir, name).select(F.col(f"{x}_nationkey").cast("long").alias("parent"), F.floor(F.col(f"{x}_acctbal") / 100).cast("long").alias("key"), *keep)
    sources = items("supplier", "s", "s_suppkey").groupBy("parent", "key").agg(F.min("s_suppkey").alias("pos"))
    return C.missing_siblings(items("customer", "c"), sources)


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS gram FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM w)
SELECT gram, count(*)::BIGINT AS df, round(ln(1 + (SELECT n FROM n) / (1 + count(*))), 9) AS weight FROM w GROUP BY gram""")
def idf_weights(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block"), F.explode(found).alias("gram"))
    n = words.select("block").distinct().count()
    return M.idf_weights(words, F.lit(n)).withColumn("weight", F.round("weight", 9))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS gram FROM documents), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS gram FROM benchmark),
n AS (SELECT count(DISTINCT item_id) AS n FROM b), i AS (SELECT gram, ln(1 + (SELECT n FROM n) / (1 + count(*))) AS w FROM b GROUP BY gram),
s AS (SELECT doc_id, item_id, sum(w) AS score FROM w JOIN i USING (gram) JOIN b USING (gram) GROUP BY ALL)
SELECT doc_id AS target, item_id AS block, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) <= 4""")
def idf_topk(spark, sf_dir):
    words = lambda name, key, new: table(spark, sf_dir, name).select(F.col(key).alias(new), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("grams"))
    return M.weighted_hits(words("documents", "doc_id", "target"), words("benchmark", "item_id", "block"), 4).select("target", "block", F.round("score", 6).alias("score"))


@query(f"""WITH {_SIDES}, e AS (SELECT DISTINCT doc, index FROM t JOIN s USING (n) WHERE n != '' AND length(n) >= 4),
c AS (SELECT DISTINCT doc, index FROM h WHERE hits >= 0.82 * tn AND tn >= 8)
SELECT t.doc, count(*) FILTER (e.doc IS NOT NULL)::BIGINT AS ready, count(*) FILTER (e.doc IS NULL AND c.doc IS NOT NULL)::BIGINT AS review, count(*) FILTER (e.doc IS NULL AND c.doc IS NULL)::BIGINT AS retained
FROM t LEFT JOIN e USING (doc, index) LEFT JOIN c USING (doc, index) WHERE n != '' GROUP BY t.doc""")
def summary_counts(spark, sf_dir):
    targets, sources = sides(spark, sf_dir)
    exact = sources.select("kind", "n").distinct().withColumn("e", F.lit(True))
    near = M.gram_hits(targets, sources, keep=1, share=0.82).where("t_size >= 8").select("doc", "index").distinct().withColumn("c", F.lit(True))
    judged = targets.join(exact, ["kind", "n"], "left").join(near, ["doc", "index"], "left").withColumn("status", F.when(F.col("e"), "ready").when(F.col("c"), "review").otherwise("retained"))
    return resolve.summary(judged, ["doc"]).select("doc", F.col("source_updates").alias("ready"), "review", "retained")


@query("""SELECT doc_id, substr(sha256(concat_ws('|', source, doc_id, -1, substr(translate(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g'), '（），。：；', '(),.:;'), 1, 180))), 1, 20) AS id FROM documents""".replace("\\\\", "\\"))
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_id("source", F.col("doc_id"), F.lit(-1), "text").alias("id"))


@query("""WITH m AS (SELECT conv_id, turn, turn + coalesce(length(text), 0) % 2 AS source, role = 'user' AND turn % 5 = 0 AS anchor FROM conversations),
r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, source - turn ORDER BY turn) AS run FROM m)
SELECT conv_id, turn, source, anchor FROM r QUALIFY bool_or(anchor) OVER (PARTITION BY conv_id, source - turn, run)""")
def diagonal_fixpoint(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), (F.col("turn") + F.coalesce(F.length("text"), F.lit(0)) % 2).alias("source"), ((F.col("role") == "user") & (F.col("turn") % 5 == 0)).alias("anchor"))
    return C.extend_on_diagonal(m, ["conv_id"]).select("conv_id", F.col("index").alias("turn"), "source", "anchor")


@query("""SELECT event_type, user_id % 50 AS block, count(*)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(props))), ';') AS details FROM events GROUP BY ALL""")
def merged_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), (F.col("user_id") % 50).alias("block"), F.lit("t").alias("title"), F.col("props").alias("detail"), F.array("event_type").alias("evidence"))
    counts = e.groupBy("rule", "block").agg(F.count("*").alias("n"))
    return C.merged_findings(e).join(counts, ["rule", "block"]).select(F.col("rule").alias("event_type"), "block", "n", F.concat_ws(";", "details").alias("details"))


@query(f"""WITH {_PARAGRAPHS}, a AS (SELECT text, count(*) AS n FROM p GROUP BY text), b AS (SELECT text, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM conversations) GROUP BY text)
SELECT text, (a.n - coalesce(b.n, 0))::BIGINT AS surplus FROM a LEFT JOIN b USING (text) WHERE a.n > coalesce(b.n, 0)""")
def surplus_copies(spark, sf_dir):
    lines = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return C.surplus_copies(B.split_blocks(table(spark, sf_dir, "conversations"), "conv_id", "text"), lines, "text")


@query("""SELECT c_nationkey, c_custkey, coalesce(last_value(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 'other') AS section FROM customer""")
def section_state(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("index"), "c_acctbal", "c_mktsegment")
    return B.section_state(people, F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), ["c_nationkey"]).select("c_nationkey", "c_custkey", "section")


@query("""WITH g AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity) AS w FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey, w, list_transform(w, lambda x: x * 9000 // list_sum(w)) AS v FROM g)
SELECT l_orderkey, array_to_string(list_concat(v[1:len(v) - 1], [v[len(v)] + 9000 - list_sum(v)]), ',') AS widths FROM s""")
def column_widths(spark, sf_dir):
    # An order has few lines, so its list is short.
    widths = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))), lambda x: x["q"])
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(widths.alias("w"))
    return g.select("l_orderkey", F.concat_ws(",", tables.column_widths(F.col("w"), F.lit(9000).cast("long")).cast("array<string>")).alias("widths"))


@query("""WITH w AS (SELECT url, page_id, 100 * (html LIKE '%<h1>%')::INT + 30 * (length(html) > 4000)::INT - 40 * (page_id % 7 = 0)::INT AS score FROM pages), h AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/]+') AS host FROM w)
SELECT host, page_id, score::BIGINT AS score FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) = 1""")
def recommended(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # The score's own terms: no revision tells of 15 points that these pages don't have, so all have one.
    files = pages.select(
        F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("issuer"), F.lit("").alias("chapter"), F.col("page_id").alias("seq"), F.contains("html", F.lit("<h1>")).alias("original"),
        (F.length("html") > 4000).alias("pending"), (F.col("page_id") % 7 == 0).alias("revised"), F.lit(1).alias("revisions"),
    )
    return longs(uploads.recommended(files).select(F.col("issuer").alias("host"), F.col("seq").alias("page_id"), "score"))


@query()
def literal_ratio(spark, sf_dir):
    """Literal ratio of each line with every item that shares a gram with it; held against a plain version in the tests."""
    hits = M.gram_hits(*sides(spark, sf_dir), keep=None, within=math.inf)
    return longs(hits.select("doc", "index", F.col("source_index").alias("item_id"), F.round("literal", 9).alias("literal")))


@query()
def sentence_windows(spark, sf_dir):
    """Runs of up to three sentences, cut at the ideographic full stop after the points of the text are set as such."""
    lines = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.replace("text", F.lit("."), F.lit("。")))
    return longs(B.sentence_windows(lines))


@query()
def analyze_documents(spark, sf_dir):
    """The whole analysis of document lines against the benchmark items."""
    _, sources = sides(spark, sf_dir)
    targets = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return longs(analyze(sources.select("index", "kind", "text"), targets).drop("candidates", "table_projection"))


def _key(x: str) -> str:
    return rf"""lower(regexp_replace(trim(regexp_replace({x}, '{R.LONG_LEAD}', '')), '[\t-\r \x{{3000}}\x{{a0}}，。；：、“”‘’（）()《》:;,.\-—]+', '', 'g'))"""


_LEVELS = " ".join(f"WHEN '{tag}' THEN {level}" for tag, level in P.LEVELS.items())
#: Blocks of pages, and the headings with the places where their scopes end and the keys above them.
_OUTLINES = f"""l AS MATERIALIZED (SELECT *, CASE WHEN length(text) <= {P.LONGEST} THEN CASE tag {_LEVELS} END END AS level FROM (SELECT page_id AS doc, url LIKE 'https:%' AS src, generate_subscripts(t, 1) - 1 AS index, unnest(t) AS tag, unnest(x) AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '{P.ELEMENT}', 1) AS t, regexp_extract_all(html, '{P.ELEMENT}', 2) AS x FROM pages))),
h AS MATERIALIZED (SELECT a.doc, a.src, a.index AS hd, a.text AS title, {_key("a.text")} AS key, a.level, coalesce(min(k.index), 1000000000) AS stop FROM l a LEFT JOIN l k ON k.doc = a.doc AND k.index > a.index AND k.level <= a.level WHERE a.level IS NOT NULL GROUP BY ALL),
n AS MATERIALIZED (SELECT h.doc, h.hd, list(u.key ORDER BY u.hd) FILTER (u.key IS NOT NULL) AS outside FROM h LEFT JOIN h u ON u.doc = h.doc AND u.hd < h.hd AND h.hd < u.stop AND length(u.key) >= 4 GROUP BY h.doc, h.hd),
o AS MATERIALIZED (SELECT l.doc, l.src, l.index, l.text, l.level, h.hd FROM l JOIN h ON h.doc = l.doc AND h.hd < l.index AND l.index < h.stop),
c AS MATERIALIZED (SELECT h.doc, h.src, h.hd, h.title, h.key, coalesce(n.outside, []) AS outside, h.hd + 1 AS start, g."end", g.leaf, g.body FROM h JOIN n USING (doc, hd) JOIN (SELECT doc, hd, max(index) FILTER (trim(text, ' ') != '') + 1 AS "end",
  bool_and(level IS NULL) AS leaf, regexp_replace(string_agg(text, '' ORDER BY index) FILTER (trim(text, ' ') != ''), '[ \\t-\\r]+', '', 'g') AS body FROM o GROUP BY doc, hd) g USING (doc, hd) WHERE g."end" IS NOT NULL)"""


def outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages by http as targets, pages by https as sources, both with their outlines."""
    pages = table(spark, sf_dir, "pages")
    outline = scopes.outlined(P.page_blocks(pages).join(pages.select(F.col("page_id").alias("doc"), F.col("url").startswith("https:").alias("src")), "doc"))
    return outline.where("NOT src").drop("src"), outline.where("src").drop("src")


@query(f"""WITH {_OUTLINES} SELECT doc, src, hd::BIGINT AS "at", key, array_to_string(outside, ' > ') AS outside, start::BIGINT AS start, "end"::BIGINT AS "end", leaf, sha256(body) AS body FROM c""")
def scope_catalogue(spark, sf_dir):
    """Every heading's scope of every page, nested ones too."""
    both = [scopes.scope_catalogue(side).withColumn("src", F.lit(src)) for side, src in zip(outlines(spark, sf_dir), (False, True), strict=True)]
    return longs(both[0].unionByName(both[1]).select("doc", "src", "at", "key", F.concat_ws(" > ", "outside").alias("outside"), "start", "end", "leaf", F.sha2("body", 256).alias("body")))


@query(f"""WITH {_OUTLINES},
f AS (SELECT doc, src, index, regexp_replace(text, '[ \\t-\\r]+', '', 'g') AS form, (SELECT max(hd) FROM h WHERE h.doc = l.doc AND h.hd < l.index AND l.index < h.stop) AS hd FROM l WHERE level IS NULL),
u AS (SELECT form, min((doc, index)) AS s FROM f WHERE src AND length(form) >= 20 GROUP BY form HAVING count(*) = 1),
a AS MATERIALIZED (SELECT f.doc, f.hd, f.index, s[1] AS source_doc, s[2] AS source_index FROM f JOIN u USING (form) WHERE NOT src AND f.hd IS NOT NULL),
m AS MATERIALIZED (SELECT a.doc, a.hd, a.source_doc, o.hd AS source_at, count(DISTINCT source_index) AS n, list(source_index ORDER BY a.index, source_index) AS places FROM a JOIN o ON o.doc = source_doc AND o.index = source_index GROUP BY a.doc, a.hd, a.source_doc, o.hd),
z AS MATERIALIZED (SELECT *, places = list_sort(places) AS ordered, min(hd) OVER w != max(hd) OVER w AS shared FROM m WINDOW w AS (PARTITION BY doc, source_doc, source_at)),
t AS (SELECT * FROM c WHERE NOT src AND leaf AND length(key) >= 4), s AS (SELECT * FROM c WHERE src AND leaf),
k AS (SELECT t.doc, t.hd, t.start, t."end", t.body, s.doc AS source_doc, s.hd AS source_at, s.start AS source_start, s."end" AS source_end, s.body AS source_body, s.key AS s_key, false AS renamed FROM t JOIN s USING (key)
  LEFT JOIN z ON z.doc = t.doc AND z.hd = t.hd AND z.source_doc = s.doc AND z.source_at = s.hd
  WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.doc = t.doc AND y.source_doc = s.doc AND y.source_at = s.hd AND y.hd != t.hd) AND (z.n IS NOT NULL OR list_has_any(t.outside, s.outside))
  UNION ALL SELECT t.doc, t.hd, t.start, t."end", t.body, s.doc, s.hd, s.start, s."end", s.body, s.key, true FROM z JOIN t ON z.doc = t.doc AND z.hd = t.hd JOIN s ON z.source_doc = s.doc AND z.source_at = s.hd WHERE z.n >= 2 AND z.ordered AND NOT z.shared AND t.key != s.key),
p AS (SELECT * FROM (SELECT *, bool_and(renamed) OVER (PARTITION BY doc, hd) AS all_renamed FROM k) WHERE renamed = all_renamed),
q AS MATERIALIZED (SELECT *, body = source_body AS same FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.doc = x.doc AND y.hd = x.hd AND y.source_doc = x.source_doc AND y.s_key = x.s_key AND length(y.source_body) > length(x.source_body) AND contains(y.source_body, x.source_body))),
d AS (SELECT doc, hd, source_body, same, count(DISTINCT source_doc) AS n_docs FROM q GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY doc, hd ORDER BY same DESC, n_docs DESC, length(source_body) DESC, source_body) AS version FROM d),
r AS (SELECT doc, hd, max(version) AS n_versions, coalesce(max(version) = 1 OR (bool_or(same) FILTER (version = 1) AND NOT bool_or(same) FILTER (version = 2)) OR (max(n_docs) FILTER (version = 1) >= 2 AND max(n_docs) FILTER (version = 1) > max(n_docs) FILTER (version = 2)), false) AS sure FROM v GROUP BY doc, hd),
w AS (SELECT q.*, v.version, v.n_docs, r.n_versions, r.sure FROM q JOIN v USING (doc, hd, source_body) JOIN r USING (doc, hd))
SELECT doc, hd::BIGINT AS "at", start::BIGINT AS start, "end"::BIGINT AS "end", source_doc, source_at::BIGINT AS source_at, source_start::BIGINT AS source_start, source_end::BIGINT AS source_end, renamed, same, n_versions::BIGINT AS n_versions, n_docs::BIGINT AS n_docs,
  CASE WHEN sure THEN 'auto' ELSE 'review' END AS status FROM w QUALIFY row_number() OVER (PARTITION BY doc, hd ORDER BY CASE WHEN sure THEN version END, same DESC, source_doc, source_start) = 1""")
def scope_reconcile(spark, sf_dir):
    """The whole source scope that each leaf of a target page stands for."""
    targets, sources = (written(side, "outline") for side in outlines(spark, sf_dir))
    found = scopes.reconcile_scopes(scopes.scope_catalogue(targets), scopes.scope_catalogue(sources), scopes.unique_anchors(targets, sources))
    return longs(found)


_SUBJECTS = f"""f AS MATERIALIZED (SELECT l.doc, l.src, l.index, l.level, regexp_replace(l.text, '[ \\t-\\r]+', '', 'g') AS form, list(h.key ORDER BY h.at) FILTER (NOT regexp_matches(h.title, '{recovery.ABOUT_INSPECTION}')) AS k, max(h.at) AS at
  FROM l LEFT JOIN h ON h.doc = l.doc AND h.at < l.index AND l.index < h.stop WHERE l.level IS NULL GROUP BY ALL),
u AS (SELECT form, min((doc, index)) AS s FROM f WHERE src AND length(form) >= 20 GROUP BY form HAVING count(*) = 1),
a0 AS (SELECT f.doc, f.index AS i, s[1] AS sd, s[2] AS si FROM f JOIN u USING (form) WHERE NOT src AND f.at IS NOT NULL),
pp AS MATERIALIZED (SELECT t.doc, t.index AS i, s.doc AS sd, s.index AS si FROM f t JOIN f s USING (form) WHERE NOT t.src AND s.src AND form != '' AND t.k[-1] = s.k[-1] AND (length(t.k[-1]) >= 4 OR (t.k[-2] = s.k[-2] AND length(t.k[-2]) >= 4))),
w AS (SELECT t.doc, t.index AS i, s.doc AS sd, s.index AS si FROM f t JOIN f s USING (form) WHERE NOT t.src AND s.src AND length(form) >= 20),
hh AS (SELECT t.doc, t.at AS i, s.doc AS sd, s.at AS si FROM h t JOIN h s ON regexp_replace(t.title, '[ \\t-\\r]+', '', 'g') = regexp_replace(s.title, '[ \\t-\\r]+', '', 'g') AND t.level = s.level WHERE NOT t.src AND s.src AND length(t.key) >= 8),
e AS MATERIALIZED (SELECT doc, i, sd, si, i - 1 AS pi, si - 1 AS psi FROM pp UNION SELECT doc, i, sd, si, i + 1, si + 1 FROM pp
  UNION SELECT p.doc, p.i, p.sd, p.si, w.i, w.si FROM pp p JOIN w ON w.doc = p.doc AND w.sd = p.sd AND w.i = p.i - 2 AND w.si = p.si - 2 JOIN hh ON hh.doc = p.doc AND hh.sd = p.sd AND hh.i = p.i - 1 AND hh.si = p.si - 1)"""
_NEXT = """SELECT doc, i, min((sd, si)) AS s, count(*) = 1 AS taken FROM (SELECT DISTINCT e.doc, e.i, e.sd, e.si FROM e JOIN r ON r.doc = e.doc AND r.sd = e.sd AND r.i = e.pi AND r.si = e.psi AND r.taken AND r.born = r.round)
  WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.doc = doc AND x.i = i) GROUP BY doc, i"""


@query(f"""WITH RECURSIVE {_OUTLINES}, {_SUBJECTS.replace("h.at", "h.hd").replace("t.at", "t.hd").replace("s.at", "s.hd").replace("AS at", "AS hd").replace("f.at", "f.hd")},
r(round, born, doc, i, sd, si, taken) AS (SELECT 0, 0, doc, i, sd, si, true FROM a0
  UNION ALL SELECT z.round + 1, z.born, z.doc, z.i, z.sd, z.si, z.taken FROM (SELECT round, born, doc, i, sd, si, taken FROM r UNION ALL SELECT (SELECT max(round) FROM r), (SELECT max(round) FROM r) + 1, doc, i, s[1], s[2], taken FROM ({_NEXT.replace("doc = doc", "doc = q.doc").replace("x.i = i", "x.i = q.i").replace("r.born = r.round)", "r.born = r.round) q")})) z
  WHERE EXISTS (SELECT 1 FROM ({_NEXT.replace("doc = doc", "doc = q.doc").replace("x.i = i", "x.i = q.i").replace("r.born = r.round)", "r.born = r.round) q")})))
SELECT doc, i::BIGINT AS "index", sd AS source_doc, si::BIGINT AS source_index, born::BIGINT AS round FROM r WHERE taken AND round = (SELECT max(round) FROM r)""")
def recover_coverage(spark, sf_dir):
    """Paragraphs of target pages that unique ones beside them place, and so on."""
    targets, sources = (written(side, "outline") for side in outlines(spark, sf_dir))
    return longs(recovery.recover_coverage(targets, sources, scopes.unique_anchors(targets, sources)))


@query("""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag) AS copy FROM lineitem),
i AS (SELECT l_suppkey AS k, printf('%d-%d-%d', l_orderkey, l_linenumber, copy) AS name, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag = 'N', l_extendedprice DESC, printf('%d-%d-%d', l_orderkey, l_linenumber, copy)) AS r FROM l),
g AS (SELECT k, 0::BIGINT AS r, []::STRUCT(n VARCHAR, s BIGINT, e BIGINT)[] AS kept, NULL::VARCHAR AS name, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::STRUCT(n VARCHAR, s BIGINT, e BIGINT) AS hit FROM (SELECT DISTINCT k FROM i)
  UNION ALL SELECT k, r, CASE WHEN hit IS NULL THEN list_append(kept, {'n': name, 's': s, 'e': e}) ELSE kept END, name, s, e, hit
  FROM (SELECT g.k, i.r, g.kept, i.name, i.s, i.e, list_filter(g.kept, lambda x: x.s < x.e AND i.s < i.e AND x.s < i.e AND i.s < x.e)[1] AS hit FROM g JOIN i ON i.k = g.k AND i.r = g.r + 1))
SELECT k AS l_suppkey, name, hit IS NULL AS kept, hit.n AS replaced_by, coalesce(s < hit.s OR e > hit.e, false) AS crossing FROM g WHERE name IS NOT NULL""")
def replace_overlapping(spark, sf_dir):
    """Each supplier's lines from their shipping on, a day for each piece: settled lines go before others, then the dearest."""
    lines = table(spark, sf_dir, "lineitem")
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag"))
    lines = lines.withColumn("copy", copy).withColumn("start", F.unix_date(F.to_date("l_shipdate")).cast("long"))
    intervals = lines.select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "copy").alias("name"), "start", (F.col("start") + F.col("l_quantity").cast("long")).alias("end"), "l_returnflag", "l_extendedprice")
    strength = F.struct(F.col("l_returnflag") == "N", -F.col("l_extendedprice"))
    return overlap.replace_overlapping(intervals, "l_suppkey", strength).select("l_suppkey", "name", "kept", "replaced_by", "crossing")


@query()
def complete_sections(spark, sf_dir):
    """Whole sections of target pages and the source sections under the same or nearly the same heading; no SQL has the
    subsequence ratio, so it is held against a plain version in the tests."""
    targets, sources = (sections.heading_sections(written(side, "outline")) for side in outlines(spark, sf_dir))
    return longs(sections.assess_sections(sections.complete_sections(targets, sources)))


@query(f"""WITH {_OUTLINES} SELECT l.doc, l.index::BIGINT AS "index", coalesce(string_agg(h.title, ' > ' ORDER BY h.hd), '') AS path FROM l LEFT JOIN h ON h.doc = l.doc AND h.hd <= l.index AND l.index < h.stop GROUP BY l.doc, l.index""")
def heading_path(spark, sf_dir):
    """The open headings of every block of every page."""
    return longs(B.heading_path(P.page_blocks(table(spark, sf_dir, "pages"))).select("doc", "index", F.concat_ws(" > ", "path").alias("path")))


@query(f"""WITH {_OUTLINES} SELECT l.doc, l.index::BIGINT AS "index", CASE WHEN h.stop = 1000000000 THEN max(l.index) OVER (PARTITION BY l.doc) + 1 ELSE h.stop END::BIGINT AS scope_end FROM l LEFT JOIN h ON h.doc = l.doc AND h.hd = l.index""")
def scope_end(spark, sf_dir):
    """Where the scope of every heading of every page ends."""
    return longs(B.scope_end(P.page_blocks(table(spark, sf_dir, "pages"))).select("doc", "index", "scope_end"))


@query(f"""WITH f AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'assets' WHEN 2 THEN 'debts' WHEN 3 THEN 'equity' END AS metric, round(l_extendedprice, 2)::DECIMAL(38,12) AS value, (l_quantity::INT * 500)::DECIMAL(38,12) AS tolerance FROM lineitem),
m AS (SELECT l_orderkey, metric, max(value) AS value, max(tolerance) AS tolerance FROM f WHERE metric IS NOT NULL GROUP BY ALL),
w AS (SELECT l_orderkey, max(value) FILTER (metric = 'assets') - max(value) FILTER (metric = 'debts') - max(value) FILTER (metric = 'equity') AS gap, sum(tolerance) AS tol FROM m GROUP BY l_orderkey)
SELECT l_orderkey, gap::DOUBLE AS gap, abs(gap) <= tol AS balanced FROM w WHERE gap IS NOT NULL""")
def equation_check(spark, sf_dir):
    """Whether an order's first line is the sum of the next two, within tolerances by their pieces."""
    line = F.col("l_linenumber")
    metric = F.when(line == 1, "assets").when(line == 2, "debts").when(line == 3, "equity")
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", metric.alias("metric"), F.round("l_extendedprice", 2).cast("decimal(38,12)").alias("value"), (F.col("l_quantity").cast("int") * 500).cast("decimal(38,12)").alias("tolerance"))
    return C.equation(facts, ["l_orderkey"], "metric", "assets", ["debts", "equity"]).withColumn("gap", F.col("gap").cast("double"))


_MENU = "<li><a [^>]*>([^<]*)</a></li>"


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu entries of pages; those of more than three characters make the smaller table."""
    entries = F.regexp_extract_all("html", F.lit(_MENU), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", entries.alias("s"), F.filter(entries, lambda x: F.length(x) > 3).alias("t"))


@query(f"""WITH r AS (SELECT page_id, regexp_extract_all(html, '{_MENU}', 1) AS s FROM pages), p AS (SELECT page_id, s, list_filter(s, lambda x: length(x) > 3) AS t FROM r),
q AS (SELECT *, len(s) = len(list_distinct(s)) AND len(s) > 0 AND len(t) > 0 AS ok, list_transform(t, lambda k: list_position(s, k) - 1) AS pos FROM p)
SELECT page_id, CASE WHEN NOT ok THEN NULL WHEN t = s THEN '' ELSE array_to_string(pos, ',') END AS places FROM q""")
def header_subset(spark, sf_dir):
    """Places of a menu's longer entries among all of them, both taken as header rows."""
    matrix = lambda c: tables.cells(F.concat(F.array_join(c, "|"), F.lit("\n"), F.array_join(c, "|")))
    keys = menus(spark, sf_dir).select("page_id", tables.header_keys(matrix("t")).alias("tk"), tables.header_keys(matrix("s")).alias("sk"))
    places = tables.projection(F.col("tk"), F.col("sk"))
    return keys.select("page_id", F.when(places.isNotNull(), F.array_join(places.cast("array<string>"), ",")).alias("places"))


@query(f"""WITH r AS (SELECT page_id, regexp_extract_all(html, '{_MENU}', 1) AS s FROM pages), u AS (SELECT page_id, generate_subscripts(s, 1) AS i, unnest(s) AS raw FROM r),
k AS (SELECT page_id, i, raw, regexp_replace(regexp_replace({_compact(f"trim(regexp_replace(raw, '{R.LONG_LEAD}', ''))")}, '[(（][^)）]*[)）]', '', 'g'), '[:,.;、]', '', 'g') AS k FROM u),
d AS (SELECT page_id, k, min(i) AS i FROM k WHERE k != '' GROUP BY page_id, k HAVING max(length(raw)) <= 3)
SELECT r.page_id, coalesce(string_agg(d.k, ',' ORDER BY d.i), '') AS lost FROM r LEFT JOIN d USING (page_id) GROUP BY r.page_id""")
def lost_labels(spark, sf_dir):
    """Row labels of the whole menu that the table of its longer entries lacks."""
    matrix = lambda c: tables.cells(F.concat_ws("\n", F.lit("h|v"), F.transform(c, lambda x: F.concat(x, F.lit("|1")))))
    return menus(spark, sf_dir).select("page_id", F.array_join(tables.lost_labels(matrix("s"), matrix("t")), ",").alias("lost"))


@query(rf"""WITH {_PARAGRAPHS}, k AS (SELECT doc, index, text AS s, regexp_extract(text, '{R.LEAD}') AS lead FROM p)
SELECT doc, index::BIGINT AS index, lead, regexp_replace(s, '{R.LEAD}', '') AS body, trim(regexp_replace(s, '{R.LONG_LEAD}', '')) AS stripped,
  replace(replace(s, '发行人', '公司'), '本公司', '公司') AS adapted, length(s) < 90 AND regexp_matches(s, '{R.HEADING_START}') AS headingish,
  CASE WHEN regexp_matches(s, '[。；;]$') OR regexp_matches(s, '{R.NOT_HEADING}') THEN NULL {" ".join(f"WHEN regexp_matches(s, '{p}') THEN {n}" for n, p, _ in R.HEADING_LEVELS)} END::BIGINT AS level FROM k""")
def lead_forms(spark, sf_dir):
    """Leads and what they leave, of every line of every document."""
    lines = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return longs(lines.select("doc", "index", T.lead("text").alias("lead"), T.after_lead("text").alias("body"), T.strip_lead("text").alias("stripped"), T.adapt("text").alias("adapted"), T.headingish("text").alias("headingish"), T.heading_level("text").alias("level")))


@query(f"""WITH {_PARAGRAPHS} SELECT doc, index::BIGINT AS index, array_to_string(list_transform(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: replace(x, ',', '')), ';') AS numbers,
  array_to_string(regexp_extract_all(text, '(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[0-9]+\\.[0-9]+|[0-9]+)%'), ';') AS percentages FROM p""")
def evidence_numbers(spark, sf_dir):
    """Numbers and percentages of every line of every document."""
    lines = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return longs(lines.select("doc", "index", F.concat_ws(";", T.evidence_numbers("text")).alias("numbers"), F.concat_ws(";", T.percentages("text")).alias("percentages")))


_PERIOD = "((?:19|20)[0-9]{2})(?:年度?)?(?:[-－—–至]|到)((?:19|20)[0-9]{2})年|((?:19|20)[0-9]{2})年(?:(?:[0-9]{1,2}[-－—–至])?([0-9]{1,2})月)?"


@query(f"""WITH v AS (SELECT o_orderkey, concat(year(o_orderdate) - o_custkey % 3, '-', year(o_orderdate), '年及', year(o_orderdate), '年1-', month(o_orderdate), '月，', year(o_orderdate), '年度') AS s FROM orders),
r AS (SELECT o_orderkey, unnest(regexp_extract_all(s, '{_PERIOD}')) AS m, generate_subscripts(regexp_extract_all(s, '{_PERIOD}'), 1) AS i FROM v),
g AS (SELECT o_orderkey, i, regexp_extract(m, '{_PERIOD}', 1) AS a, regexp_extract(m, '{_PERIOD}', 2) AS b, regexp_extract(m, '{_PERIOD}', 3) AS y, regexp_extract(m, '{_PERIOD}', 4) AS mo FROM r),
e AS (SELECT o_orderkey, i, 0 AS k, CASE WHEN mo = '' THEN y ELSE y || '-' || lpad(mo, 2, '0') END AS p FROM g WHERE a = ''
  UNION ALL SELECT o_orderkey, i, k, (a::INT + k)::VARCHAR FROM g, range(6) AS t(k) WHERE a != '' AND (k = 0 OR a::INT + k <= b::INT)),
f AS (SELECT o_orderkey, p, min((i, k)) AS pos FROM e GROUP BY o_orderkey, p)
SELECT v.o_orderkey, coalesce(string_agg(p, ',' ORDER BY pos), '') AS periods FROM v LEFT JOIN f USING (o_orderkey) GROUP BY v.o_orderkey""")
def reporting_periods(spark, sf_dir):
    """Periods named in a phrase about each order's date."""
    year, text = F.year("o_orderdate"), lambda *x: F.concat(*(c if not isinstance(c, str) else F.lit(c) for c in x))
    phrase = text(year - F.col("o_custkey") % 3, "-", year, "年及", year, "年1-", F.month("o_orderdate"), "月，", year, "年度")
    return table(spark, sf_dir, "orders").select("o_orderkey", phrase.alias("s")).select("o_orderkey", F.concat_ws(",", T.periods("s")).alias("periods"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice)::BIGINT::VARCHAR ELSE round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR END AS s, CASE o_orderpriority WHEN '1-URGENT' THEN '亿元' WHEN '2-HIGH' THEN '万元' ELSE '元' END AS unit FROM orders)
SELECT o_orderkey, s, unit, (s::DECIMAL(38,12) * CASE unit WHEN '亿元' THEN 10000 WHEN '万元' THEN 1 ELSE 0.0001 END)::DOUBLE AS base, CASE WHEN s LIKE '%.%' THEN 0.005 ELSE 0.5 END::DOUBLE AS tolerance FROM v""")
def money_scale(spark, sf_dir):
    """Each order's total as a text in one of three units, in ten thousand yuan with the tolerance that it shows."""
    price = F.when(F.col("o_orderstatus") == "P", F.round("o_totalprice").cast("long").cast("string")).otherwise(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))
    unit = F.when(F.col("o_orderpriority") == "1-URGENT", "亿元").when(F.col("o_orderpriority") == "2-HIGH", "万元").otherwise("元")
    r = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("s"), unit.alias("unit"))
    return r.select("o_orderkey", "s", "unit", C.unit_scaled(T.decimal("s"), F.col("unit"), R.Units().scale).cast("double").alias("base"), T.shown_tolerance("s").cast("double").alias("tolerance"))


@query(f"""WITH {_OUTLINES}, y AS (SELECT p.doc, p.hd AS a, h.hd AS child, h.key, h.level, min(h.level) OVER (PARTITION BY p.doc, p.hd) AS least FROM h p JOIN h ON h.doc = p.doc AND h.hd > p.hd AND h.hd < p.stop)
SELECT doc, a::BIGINT AS "at", child::BIGINT AS child, key, (row_number() OVER (PARTITION BY doc, a ORDER BY child))::BIGINT AS pos, (count(*) OVER (PARTITION BY doc, a))::BIGINT AS n FROM y WHERE level = least""")
def direct_children(spark, sf_dir):
    """The headings right under each heading of every page."""
    return longs(sections.direct_children(scopes.outlined(P.page_blocks(table(spark, sf_dir, "pages")))))


_MARKS = {"“": "”", "(": ")", "[": "]", "{": "}"}
_CLOSER = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MARKS.items())


@query(f"""WITH {_PARAGRAPHS}, k AS (SELECT doc, index, regexp_replace(text, '[^“”(){{}}\\[\\]]+', '', 'g') AS m FROM p),
w AS (SELECT doc, index, coalesce(string_agg(m, '') OVER (PARTITION BY doc ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, string_agg(m, '') OVER (PARTITION BY doc ORDER BY index) AS a FROM k),
s AS (SELECT doc, index, {", ".join(f"list_reduce(list_prepend('', string_split({x}, '')), lambda t, c: CASE WHEN c IN ({', '.join(repr(m) for m in _MARKS)}) THEN t || CASE c {_CLOSER} END WHEN c != '' AND t[-1] = c THEN t[:-2] ELSE t END) AS {x}{x}" for x in "ab")} FROM w)
SELECT doc, index::BIGINT AS index, length(aa)::BIGINT AS depth, length(aa) > 0 OR length(bb) > 0 AS quoted FROM s""")
def quote_state(spark, sf_dir):
    """Marks and brackets that are open at each line of every document."""
    lines = B.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return longs(quotes.quote_state(lines, _MARKS, stretch=16).select("doc", "index", "depth", "quoted"))


@query("""WITH d AS (SELECT sha256(to_json({'conv_id': conv_id, 'role': role, 'turn': turn})::VARCHAR) AS d FROM conversations),
s AS (SELECT count(*) AS n, coalesce(sum(('0x' || d[1:15])::HUGEINT), 0) AS a, coalesce(sum(('0x' || d[16:30])::HUGEINT), 0) AS b, coalesce(sum(('0x' || d[31:45])::HUGEINT), 0) AS c, coalesce(sum(('0x' || d[46:60])::HUGEINT), 0) AS e FROM d)
SELECT n::BIGINT AS n, sha256(concat_ws(':', n, a::HUGEINT, b::HUGEINT, c::HUGEINT, e::HUGEINT)) AS digest FROM s""")
def frozen_digest(spark, sf_dir):
    """One digest of all turns, whatever their order."""
    return frozen.table_digest(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role"])


@query("""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_extendedprice, l_suppkey) AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice, l_suppkey) AS place FROM lineitem),
x AS (SELECT l_orderkey, max(pos) AS n FROM d GROUP BY l_orderkey),
g AS (SELECT l_orderkey, 0::BIGINT AS pos, 0::BIGINT AS last, NULL::BIGINT AS met FROM x
  UNION ALL SELECT g.l_orderkey, g.pos + 1, coalesce(h.place, g.last), h.place FROM g JOIN x ON x.l_orderkey = g.l_orderkey AND g.pos < x.n JOIN d t ON t.l_orderkey = g.l_orderkey AND t.pos = g.pos + 1
    LEFT JOIN LATERAL (SELECT min(s.place) AS place FROM d s WHERE s.l_orderkey = g.l_orderkey AND s.place > g.last AND s.l_returnflag = t.l_returnflag) h ON true)
SELECT l_orderkey, pos, met AS source_pos FROM g WHERE met IS NOT NULL""")
def tables_in_order(spark, sf_dir):
    """Each order's lines by number matched to its lines by shipping, in order, by return flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), "l_linenumber", "l_shipdate", "l_extendedprice", "l_suppkey", F.col("l_returnflag").alias("schema"))
    side = lambda *order: lines.select("section", "schema", F.row_number().over(Window.partitionBy("section").orderBy(*order)).alias("pos"))
    targets = side("l_linenumber", "l_shipdate", "l_extendedprice", "l_suppkey")
    return sections.tables_in_order(targets, side("l_shipdate", "l_linenumber", "l_extendedprice", "l_suppkey")).select(F.col("section").alias("l_orderkey"), "pos", "source_pos")


_ABOUT = {"party": ("o_orderstatus", {"F": "前五大客户", "O": "前五大供应商"}), "measure": ("o_orderpriority", {"1-URGENT": "营业收入", "2-HIGH": "主营业务成本", "3-MEDIUM": "毛利率"})}


def _cases(words: dict[str, str]) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, '表1：' || year(o_orderdate) || '年' || CASE o_orderstatus {_cases(_ABOUT['party'][1])} ELSE '' END || CASE o_custkey % 3 WHEN 0 THEN '电力' WHEN 1 THEN '食品' ELSE '' END || CASE o_orderpriority {_cases(_ABOUT['measure'][1])} ELSE '' END || '情况' AS caption,
  CASE WHEN month(o_orderdate) % 2 = 0 THEN '单位：万元' ELSE '' END AS unit_line, CASE WHEN month(o_orderdate) % 5 = 0 THEN '客户' ELSE '名称' END || ' 金额（元）' AS header, CASE WHEN o_orderstatus = 'P' THEN '母公司财务报表' ELSE '合并财务报表' END AS heading FROM orders),
i AS (SELECT *, list_sort(list_distinct(regexp_extract_all(caption, '((?:19|20)[0-9]{{2}})年', 1))) AS periods, CASE WHEN unit_line != '' THEN split_part(unit_line, '：', 2) ELSE regexp_extract(header, '（(.*)）', 1) END AS unit,
  CASE WHEN regexp_matches(heading, '母公司') THEN '本部' ELSE '合并' END AS scope,
  CASE WHEN regexp_matches(caption, '客户') THEN '客户' WHEN regexp_matches(caption, '供应商') THEN '供应商' ELSE '' END AS pt, CASE WHEN regexp_matches(header, '客户') THEN '客户' ELSE '' END AS ph,
  list_filter(['营业收入', '主营业务成本', '毛利率'], lambda m: contains(caption, m)) AS m, list_filter(['电力', '食品'], lambda b: contains(caption, b)) AS b FROM o),
j AS (SELECT *, pt != '' AND ph != '' AND pt != ph AS clash, CASE WHEN pt != '' THEN pt ELSE ph END AS party, lead(o_orderkey) OVER w AS nk FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
v AS (SELECT t.o_orderkey, s.o_orderkey AS source_key, t.caption AS tc, s.caption AS sc, t.periods AS tp, s.periods AS sp, t.unit AS tu, s.unit AS su, CASE WHEN t.scope != s.scope THEN 'scope' WHEN t.clash OR s.clash THEN 'caption against header' WHEN len(t.m) > 0 AND len(s.m) > 0 AND NOT list_has_any(t.m, s.m) THEN 'measures'
  WHEN t.periods != s.periods THEN 'periods' WHEN t.party != '' AND s.party != '' AND t.party != s.party THEN 'parties' WHEN len(t.b) > 0 AND len(s.b) > 0 AND NOT list_has_any(t.b, s.b) THEN 'businesses' WHEN t.unit != s.unit THEN 'units' ELSE '' END AS veto FROM j t JOIN j s ON t.nk = s.o_orderkey)
SELECT o_orderkey, source_key, array_to_string(tp, ',') AS periods, tu AS unit, veto, tc = sc AND tp = sp AND tu = su AND veto = '' AS same FROM v""")
def table_guard(spark, sf_dir):
    """A table about each order against one about its customer's next order: the first veto, and whether they are one table."""
    pick = lambda name: F.coalesce(F.create_map(*(F.lit(x) for pair in _ABOUT[name][1].items() for x in pair))[F.col(_ABOUT[name][0])], F.lit(""))
    business = F.when(F.col("o_custkey") % 3 == 0, "电力").when(F.col("o_custkey") % 3 == 1, "食品").otherwise("")
    month = F.month("o_orderdate")
    caption = F.concat(F.lit("表1："), F.year("o_orderdate"), F.lit("年"), pick("party"), business, pick("measure"), F.lit("情况"))
    lines = F.array(caption, F.when(month % 2 == 0, "单位：万元").otherwise(""))
    text = F.concat(F.when(month % 5 == 0, "客户").otherwise("名称"), F.lit("|金额（元）\n"), F.col("o_orderpriority"), F.lit("|"), F.col("o_totalprice").cast("string"))
    path = F.array(F.lit("第一节"), F.when(F.col("o_orderstatus") == "P", "母公司财务报表").otherwise("合并财务报表"))
    about = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", guards.table_identity(lines, guards.matrices_of(text), path).alias("t"))
    following = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = about.select("o_orderkey", F.lead("o_orderkey").over(following).alias("source_key"), "t", F.lead("t").over(following).alias("s")).where("source_key IS NOT NULL")
    t, s = F.col("t"), F.col("s")
    return pairs.select("o_orderkey", "source_key", F.array_join("t.periods", ",").alias("periods"), F.array_join("t.units", ",").alias("unit"), guards.table_veto(t, s).alias("veto"), guards.same_table(t, s).alias("same"))


# Rules by a document's language; they meet inside words too, and one term is the beginning of another.
_WORDING = {"": {"the": "this", "then": "later", "of": "about", "er": "or"}, "fr": {"le": "ce", "les": "ces", "de": "hors de", "la": "cette"}, "de": {"und": "sowie", "der": "dieser"}}


def _ledger_sql(rules: dict[str, str]) -> str:
    pattern = "|".join(sorted(rules, key=lambda t: (-len(t), t)))
    return f"SELECT regexp_extract_all(text, '{pattern}') AS old, string_split_regex(text, '{pattern}') AS piece, MAP {{{', '.join(f"'{a}': '{b}'" for a, b in rules.items())}}} AS new"


@query(f"""WITH l AS (SELECT doc_id AS doc, lang, generate_subscripts(l, 1) - 1 AS index, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
g AS ({" UNION ALL BY NAME ".join(f"{_ledger_sql(r)}, doc, index FROM l WHERE {f"lang = '{k}'" if k else "lang IS NULL OR lang NOT IN ('fr', 'de')"}" for k, r in _WORDING.items())}),
p AS (SELECT *, list_transform(range(1, len(old) + 1), lambda k: list_sum(list_transform(piece[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(old[1:k - 1], lambda x: length(x))), 0)) AS pos FROM g)
SELECT doc, index::BIGINT AS index, md5(array_to_string(list_transform(range(1, len(piece) + 1), lambda k: piece[k] || CASE WHEN k <= len(old) THEN new[old[k]] ELSE '' END), '')) AS adapted,
  array_to_string(list_transform(range(1, len(old) + 1), lambda k: old[k] || '>' || new[old[k]] || '@' || pos[k]::BIGINT), ';') AS ledger FROM p""")
def wording_ledger(spark, sf_dir):
    """Each line of each document in the wording of its language's rules, and every change with its place."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("doc"), "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("index", "text"))
    told = lines.select("doc", "index", wording.adapted(F.col("text"), F.col("lang"), _WORDING).alias("w"))
    shown = F.transform("w.ledger", lambda c: F.concat(c["old"], F.lit(">"), c["new"], F.lit("@"), c["at"]))
    return longs(told.select("doc", "index", F.md5(F.col("w.text").cast("binary")).alias("adapted"), F.array_join(shown, ";").alias("ledger")))
