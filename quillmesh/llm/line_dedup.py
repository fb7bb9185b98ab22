"""Line deduplication over content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of neighbouring lines ends a chunk where it is a multiple of ``modulus``, so chunks of a
shared passage come out alike wherever it stands. Of the places of a chunk of ``min_lines`` lines or more, the one in
the smallest document (then the earliest) stays; others go once their bytes have been compared with it.

A chunk's ends may fall inside a passage that only two neighbours share. ``without_runs`` therefore extends what the
chunks find: lines beside a removed chunk, and runs too short to hold one, go by windows of ``min_lines`` lines that
stand at an earlier place, so a repeated run goes whole, wherever its neighbours change. Both compare bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.store import aside, written

_PRIME = 1_000_003


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: projections that are merged would put it into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(text: Column, window: int, modulus: int) -> Column:
    """Array of (n, text): the lines of a chunk and their text without the last line's end."""

    def of_lines(lines: Column) -> Column:
        return _let(F.transform(lines, _line_hash), lambda hashes: of_hashes(lines, hashes))

    def of_hashes(lines: Column, hashes: Column) -> Column:
        def end(_, i: Column) -> Column:
            rolled = sum((F.coalesce(F.get(hashes, i - back), F.lit(0)) * (31**back) for back in range(window)), F.lit(0))
            return F.when((rolled % _PRIME % modulus == 0) | (i == F.size(hashes) - 1), i)

        return _let(F.filter(F.transform(hashes, end), lambda e: e.isNotNull()), lambda ends: of_ends(lines, ends))

    def of_ends(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            first = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return F.struct((end - first + 1).alias("n"), F.array_join(F.slice(lines, first + 1, end - first + 1), "\n").alias("text"))

        return F.transform(ends, chunk)

    return _let(F.split(text, "\n", -1), of_lines)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is known by its id and 128 bits over id and text, so rows that repeat both count as one document."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit("b"), id_col, text_col).alias("b"))
    return docs.withColumn("id_", F.col(id_col)).withColumn("row_", F.to_json(row, {"ignoreNullFields": "false"}))


_OWN = ("id_", "row_", "chunks_", "stay_", "gone_", "lines_", "kept_", "cut_")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2, modulus: int = 3, min_lines: int = 2) -> DataFrame:
    """All rows of ``docs`` with repeated chunks taken out of the text, and ``n_lines``, ``n_removed`` (lines, long).

    A null text stays null and has no lines; an empty one is one empty line and stays. Null ids count as the smallest.
    Rows that repeat id and text keep the same chunks. Lines are split at ``\\n`` alone. Input columns named like those
    that are added are replaced. Places are pre-aggregated by chunk hash, texts move by document, so a chunk that a
    third of all documents share is no group in one task.
    """
    given = docs.drop("n_lines", "n_removed")
    docs, moved = aside(given, *_OWN)
    id_col, text_col = moved.get(id_col, id_col), moved.get(text_col, text_col)
    keyed = _keys(docs, id_col, text_col)
    keyed = keyed.withColumn("chunks_", _chunks(F.col(text_col), window, modulus))
    places = (
        keyed.select("id_", "row_", F.posexplode("chunks_").alias("k_", "chunk_"))
        .where(F.col("chunk_.n") >= min_lines)
        .select("id_", "row_", "k_", F.xxhash64("chunk_.text").alias("hash_"))
    )
    groups = (
        places.groupBy("hash_")
        .agg(F.count("*").alias("n_"), F.min(F.struct("id_", "row_", "k_")).alias("first_"))
        .where("n_ > 1")
        .drop("n_")
    )
    repeated = written(places.join(groups, "hash_"), "repeated-chunks")

    wanted = repeated.groupBy("row_").agg(F.collect_set(F.struct("k_", "hash_", "id_", "first_")).alias("wanted_"))
    # Cells are cut out before the array is exploded, so no row carries a whole text.
    cell = lambda w: F.struct(w["k_"].alias("k_"), w["hash_"].alias("hash_"), (F.struct(w["id_"], "row_", w["k_"]) <= w["first_"]).alias("stays_"), F.element_at("chunks_", w["k_"] + 1)["text"].alias("bytes_"))
    cells = keyed.select("row_", "chunks_").join(wanted, "row_").select("row_", F.transform("wanted_", cell).alias("cells_"))
    texts = written(cells.select("row_", F.explode("cells_").alias("c")).select("row_", "c.*"), "repeated-texts")
    kept = texts.where("stays_").select("hash_", F.col("bytes_").alias("kept_")).distinct()
    gone = (
        texts.where("NOT stays_")
        .join(kept, "hash_")
        .where(F.col("bytes_") == F.col("kept_"))
        .groupBy("row_")
        .agg(F.collect_set("k_").alias("gone_"))
    )
    gone = written(gone, "removed-chunks")

    stay = F.filter("chunks_", lambda c, k: ~F.array_contains("gone_", k))
    lines = lambda chunks: F.coalesce(F.aggregate(chunks, F.lit(0), lambda n, c: n + c["n"]), F.lit(0)).cast("long")
    return (
        keyed.join(gone, "row_", "left")
        .withColumn("stay_", F.when(F.col("gone_").isNull(), F.col("chunks_")).otherwise(stay))
        .withColumn("n_lines", lines("chunks_"))
        .withColumn("n_removed", F.col("n_lines") - lines("stay_"))
        .withColumn(text_col, F.when(F.col("gone_").isNull(), F.col(text_col)).otherwise(F.array_join(F.col("stay_.text"), "\n")))
        .select(*(F.col(moved.get(c, c)).alias(c) for c in given.columns), "n_lines", "n_removed")
    )


def _cut(lines: Column, modulus: int) -> Column:
    """Array of (first, n): chunks of line keys, which end where a hash over two neighbours is a multiple of
    ``modulus`` and that of the two before isn't, so that no chunk inside a text has one line."""
    closes = F.transform(lines, lambda h, i: F.pmod(F.xxhash64(F.coalesce(F.get(lines, i - 1), F.lit(0)), h), F.lit(modulus)) == 0)

    def of_closes(closes: Column) -> Column:
        ends = F.transform(closes, lambda c, i: F.when((c & ~F.coalesce(F.get(closes, i - 1), F.lit(False))) | (i == F.size(closes) - 1), i))
        return _let(F.filter(ends, lambda e: e.isNotNull()), of_ends)

    def of_ends(ends: Column) -> Column:
        first = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
        return F.transform(ends, lambda end, k: F.struct(first(k).alias("first"), (end - first(k) + 1).alias("n")))

    return _let(closes, of_closes)


_ROW = ("r1_", "r2_")
_UNIT = ("n_", "x_", "y_", "bytes_")


def _joined(lines: Column, k: Column, n) -> Column:
    return F.array_join(F.slice(lines, k + 1, n), "\n")


def _units(table: DataFrame, unit: Column, by_bytes: bool) -> DataFrame:
    """A row for each unit (k, n) of the array ``unit``: its row, place, size, 128 bits over its lines' keys, and with
    ``by_bytes`` its text. The cells are made inside the array, so that an exploded row has nothing else."""
    key = lambda u, salt: F.xxhash64(F.lit(salt), F.slice("a_", u["first"] + 1, u["n"]), F.slice("b_", u["first"] + 1, u["n"]))
    text = lambda u: _joined(F.col("lines_"), u["first"], u["n"]) if by_bytes else F.lit("")
    cell = lambda u: F.struct(u["first"].alias("k_"), u["n"].cast("int").alias("n_"), key(u, 1).alias("x_"), key(u, 2).alias("y_"), text(u).alias("bytes_"))
    return table.select("id_", *_ROW, F.explode(F.transform(unit, cell)).alias("u_")).select("id_", *_ROW, "u_.*")


def _met(units: DataFrame, name: str) -> DataFrame:
    """The units that stand at several places, each with its first; written. Places are pre-aggregated by unit.

    The first places are a table of their own, so that the join stands alone and a hot unit's partition can be split.
    """
    firsts = units.groupBy(*_UNIT).agg(F.count("*").alias("times_"), F.min(F.struct("id_", *_ROW, "k_")).alias("first_")).where("times_ > 1").drop("times_")
    firsts = written(firsts, f"first-{name}").hint("merge")
    return written(units.join(firsts, [*_UNIT]), name)


def _same_row() -> Column:
    return (F.col("r1_") == F.col("first_.r1_")) & (F.col("r2_") == F.col("first_.r2_"))


def repeated_runs(docs: DataFrame, *, id_col: str, text_col: str, min_lines: int = 2, modulus: int = 3, hash_bits: int = 64) -> DataFrame:
    """``r1_, r2_, k_, n_, by``: runs of ``n_`` lines from line ``k_`` that stand at an earlier place too.

    ``by`` is ``chunk`` for a content-defined chunk, and ``window`` for ``min_lines`` lines of which a part lies outside
    all repeated chunks: at a match's ends, or in a run too short to hold a chunk. Units meet under 128 bits; then the
    bytes of all units that met are compared. Where two texts should share a key, units meet by their bytes in a second
    turn, so keys never decide. (``hash_bits``: of each half of a line's key; fewer only make that turn likelier.)
    """
    fewer = lambda h: h if hash_bits == 64 else h % F.lit(1 << hash_bits - 1)
    line_key = lambda salt: lambda line: fewer(F.xxhash64(F.lit(salt), line.cast("binary")))
    rows = _numbered(docs, id_col, text_col).where(F.col(text_col).isNotNull())
    lines = F.split(text_col, "\n", -1)

    def turn(by_bytes: bool) -> tuple[DataFrame, DataFrame]:
        keyed = rows.select("id_", *_ROW, F.transform(lines, line_key(1)).alias("a_"), F.transform(lines, line_key(2)).alias("b_"), *([lines.alias("lines_")] if by_bytes else []))
        keyed = written(keyed, "line-keys")
        long = F.filter(_cut(F.col("a_"), modulus), lambda c: c["n"] >= min_lines)
        chunks = _met(_units(keyed, long, by_bytes), "chunks")
        later = chunks.where(~(_same_row() & (F.col("k_") == F.col("first_.k_"))))
        taken = later.groupBy(*_ROW).agg(F.collect_set(F.struct("k_", "n_")).alias("taken_"))
        inside = F.flatten(F.transform("taken_", lambda c: F.sequence(c["k_"], c["k_"] + c["n_"] - min_lines)))
        starts = F.when(F.size("a_") >= min_lines, F.sequence(F.lit(0), F.size("a_") - min_lines)).otherwise(F.array().cast("array<int>"))
        left = F.array_except(starts, F.coalesce(inside, F.array().cast("array<int>")))
        windows = F.transform(left, lambda k: F.struct(k.alias("first"), F.lit(min_lines).alias("n")))
        # the table of taken chunks grows with the corpus, so it isn't broadcast
        rest = keyed.join(taken.hint("merge"), [*_ROW], "left").withColumn("windows_", windows)
        return chunks, _met(_units(rest, F.col("windows_"), by_bytes), "windows")

    chunks, windows = turn(False)
    if _apart(rows, chunks.union(windows), text_col):
        chunks, windows = turn(True)
    later = chunks.where(~(_same_row() & (F.col("k_") == F.col("first_.k_"))))
    # windows of one text overlap: one that begins inside its first place doesn't count
    beside = windows.where(~_same_row() | (F.col("k_") - F.col("first_.k_") >= min_lines))
    pick = lambda df, by: df.select(*_ROW, "k_", "n_", F.lit(by).alias("by"))
    return pick(later, "chunk").union(pick(beside, "window"))


def _apart(rows: DataFrame, met: DataFrame, text_col: str) -> bool:
    """Whether units under one key differ in their bytes. Smallest and largest text are kept of each, so the copies of
    a unit are compared where they are and don't gather."""
    wanted = met.groupBy(*_ROW).agg(F.collect_set(F.struct("k_", "n_", "x_", "y_")).alias("wanted_"))
    texts = rows.select(*_ROW, text_col).join(wanted.hint("merge"), [*_ROW])
    cells = _let(F.split(text_col, "\n", -1), lambda lines: F.transform("wanted_", lambda u: F.struct(u["n_"].alias("n_"), u["x_"].alias("x_"), u["y_"].alias("y_"), _joined(lines, u["k_"], u["n_"]).alias("t_"))))
    seen = texts.select(F.explode(cells).alias("u_")).select("u_.*")
    unlike = seen.groupBy("n_", "x_", "y_").agg(F.min("t_").alias("least_"), F.max("t_").alias("most_")).where("least_ != most_")
    return bool(written(unlike.select("n_", "x_", "y_"), "unlike").head(1))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is known by 128 bits over its id and text, so rows that repeat both count as one document."""
    of = lambda salt: F.xxhash64(F.lit(salt), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    return docs.withColumns({"id_": F.col(id_col), "r1_": of(1), "r2_": of(2)})


_OWN_RUNS = ("id_", "r1_", "r2_", "gone_", "kept_")


def without_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, modulus: int = 3, hash_bits: int = 64) -> DataFrame:
    """All rows of ``docs`` without the lines of repeated runs, and ``n_lines``, ``n_removed`` (lines, long).

    A line goes if a window of ``min_lines`` lines around it stands at an earlier place too: in a smaller document, or
    before it in its own without overlap. So every run of that length or more whose windows stand earlier goes whole,
    and each line that goes still stands somewhere. Nulls, empty texts, null ids, rows that repeat, line ends and added
    columns are treated as in ``deduplicated``. Content-defined chunks decide first; windows extend their matches at
    both ends (:func:`repeated_runs`). Time and memory of a text are linear in its lines.
    """
    given = docs.drop("n_lines", "n_removed")
    docs, moved = aside(given, *_OWN_RUNS)
    id_col, text_col = moved.get(id_col, id_col), moved.get(text_col, text_col)
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_lines=min_lines, modulus=modulus, hash_bits=hash_bits)
    gone = runs.groupBy(*_ROW).agg(F.collect_set(F.struct("k_", "n_")).alias("gone_"))
    gone = written(gone.select(*_ROW, F.array_distinct(F.flatten(F.transform("gone_", lambda g: F.sequence(g["k_"], g["k_"] + g["n_"] - 1)))).alias("gone_")), "repeated-runs")

    lines = F.split(text_col, "\n", -1)
    kept = _let(lines, lambda found: F.transform(F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("gone_")), lambda i: F.get(found, i)))
    return (
        _numbered(docs, id_col, text_col)
        .join(gone.hint("merge"), [*_ROW], "left")  # it grows with the corpus, so it isn't broadcast
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("gone_"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("gone_").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .select(*(F.col(moved.get(c, c)).alias(c) for c in given.columns), "n_lines", "n_removed")
    )


#: The same chunks, grouped by their text, in DuckDB.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, ((h + 31 * coalesce(lag(h) OVER p, 0)) % 1000003) % 3 = 0 AS ends FROM h WINDOW p AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT rid, doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id NULLS FIRST, k) > 1 AS gone FROM c),
f AS (SELECT rid, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS kept, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed FROM r GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, lang, source, n_chars,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM (SELECT row_number() OVER () AS rid, * FROM documents) LEFT JOIN f USING (rid)
"""

#: The rule of ``without_runs`` for two lines, on the lines themselves, in DuckDB.
RUNS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (SELECT *, lead(line) OVER (PARTITION BY rid ORDER BY i) AS next FROM l),
f AS (SELECT *, first_value(rid) OVER p AS r0, first_value(i) OVER p AS i0 FROM w WINDOW p AS (PARTITION BY line, next ORDER BY doc_id NULLS FIRST, i)),
g AS (SELECT *, next IS NOT NULL AND (rid != r0 OR i - i0 >= 2) AS gone FROM f),
k AS (SELECT *, gone OR coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS out FROM g),
t AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (NOT out) AS kept, count(*) AS n_lines, count(*) FILTER (out) AS n_removed FROM k GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, lang, source, n_chars,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN t USING (rid)
"""
