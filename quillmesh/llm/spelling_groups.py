"""Spelling variants: words within one edit of each other, found by the halves of words in Aho-Corasick automata.

One edit leaves one of a word's two halves whole, as the beginning or the end of the other word. The halves are dealt to
shards by their content; a shard's automaton holds those it was dealt, and scans the words whose beginnings or ends could
be among them. A match counts where its place and the two lengths fit, and the rest of both words is then verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.memory import released
from quillmesh.llm.store import drop_table, written

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Distinct words of a task's table before it is passed on; holders of a half that are compared one by one.
_FLUSH, _FEW = 100_000, 24


def runs_of(text: str | None, piece: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of a text's runs of letters, of about ``piece`` characters each; A-Z in lower case."""
    low = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    start = 0
    while start < len(low):
        end = start + piece
        if end < len(low) and (cut := _RUN.match(low, end)):
            end = cut.end()  # a run isn't cut
        yield _RUN.findall(low, start, end)
        start = end


def damaged(run: str, start: int, every: int) -> str:
    """The run without one character where its checksum, continued from ``start``, is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """``word, n``: words of ``least_chars`` characters and ``least_n`` places or more, over whole texts.

    Of every ``every``-th (document, run) one character is deleted first. Null texts have no words, a null id counts as
    the empty text; repeated rows count each. Counts are added up in each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py()}:".encode("utf-8", "surrogatepass"))
                for runs in runs_of(text.as_py()):
                    for r, n in Counter(runs).items():
                        word = damaged(r, start, every)
                        if len(word) >= least_chars:
                            total[word] = total.get(word, 0) + n
                    if len(total) > _FLUSH:
                        yield flushed()
        yield flushed()
        released()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _parts(word: str = "word") -> Column:
    """Array of (key, holds): the word's own halves, and the beginnings and ends that halves of a word one longer or
    shorter could be. A key is ``<`` and a beginning, or ``>`` and an end."""
    w, n = F.col(word), F.length(word)
    begin = lambda m, holds: F.struct(F.concat(F.lit("<"), F.substring(w, F.lit(1), m)).alias("key"), F.lit(holds).alias("holds"))
    end = lambda m, holds: F.struct(F.concat(F.lit(">"), F.substring(w, n - m + 1, m)).alias("key"), F.lit(holds).alias("holds"))
    half = F.floor(n / 2).cast("int")
    other = F.when(n % 2 == 0, half - 1).otherwise(half + 1)  # of a word one character shorter, or longer
    return F.array(begin(half, True), begin(other, False), end(n - half, True), end(n - other, False))


def _rest(word: Column, key: Column) -> Column:
    """What of the word the half under ``key`` leaves."""
    n = F.length(key) - 1
    return F.when(F.substring(key, 1, 1) == "<", F.substring(word, n + 1, F.length(word))).otherwise(F.substring(word, F.lit(1), F.length(word) - n))


def _variants(rest: Column) -> Column:
    """The rest itself and all that deleting one character leaves of it."""
    cut = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))))
    return F.when(rest == "", F.array(rest)).otherwise(F.array_distinct(F.concat(F.array(rest), cut)))


def shortened(rest: str) -> set[str]:
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def meeting(a: str, b: str) -> str | None:
    """What two texts have in common around the one edit between them, or None if they are equal or further apart."""
    p, most = 0, min(len(a), len(b))
    while p < most and a[p] == b[p]:
        p += 1
    short = a[:p] + a[p + 1 :] if len(a) >= len(b) else a
    other = b[:p] + b[p + 1 :] if len(b) >= len(a) else b
    return short if short == other and a != b else None


class HalvesShard:
    """Words of one shard: an automaton over the halves dealt to it, and their holders by half and, for halves that
    very many words share, by a variant of the rest."""

    def __init__(self, rows: list[tuple[str, str | None, str, int, bool]]):
        self.automaton = ahocorasick.Automaton()
        holders: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.by_variant: dict[tuple[str, str], list[tuple[str, str, int]]] = defaultdict(list)
        self.split: dict[tuple[str, str], set[str]] = defaultdict(set)
        for key, variant, word, n, holds in rows:
            if variant is not None:
                self.split[key, word].add(variant)
            if holds:
                if variant is not None:
                    self.by_variant[key, variant].append((word, self.rest(word, key), n))
                    holders.setdefault(key, [])
                else:
                    holders[key].append((word, n))
        self.few = {key: [(w, self.rest(w, key), n) for w, n in found] for key, found in holders.items() if len(found) <= _FEW}
        for key, found in holders.items():
            if key not in self.few:
                for w, n in found:
                    rest = self.rest(w, key)
                    for variant in shortened(rest):
                        self.by_variant[key, variant].append((w, rest, n))
        halves: dict[str, list[str]] = defaultdict(list)
        for key in holders:
            halves[key[1:]].append(key)
        for half, keys in halves.items():
            self.automaton.add_word(half, keys)
        if halves:
            self.automaton.make_automaton()
        self.any = bool(halves)

    @staticmethod
    def rest(word: str, key: str) -> str:
        return word[len(key) - 1 :] if key[0] == "<" else word[: len(word) - len(key) + 1]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words one edit away that share a half held here; a word that shares both is given by its beginning alone."""
        for last, keys in self.automaton.iter(word) if self.any else ():
            for key in keys:
                size = len(key) - 1
                if (last + 1 != size) if key[0] == "<" else (last + 1 != len(word)):
                    continue
                rest = self.rest(word, key)
                variants = self.split.get((key, word))
                if variants is None and key in self.few:
                    found = ((w, r, n, None) for w, r, n in self.few[key])
                else:
                    found = ((w, r, n, v) for v in variants or shortened(rest) for w, r, n in self.by_variant.get((key, v), ()))
                for w, other, n, variant in found:
                    if abs(len(other) - len(rest)) > 1 or key[0] == ">" and word.startswith(other):
                        continue
                    common = meeting(rest, other)
                    if common is not None and variant in (None, common):
                        yield w, n


def near_words(words: DataFrame, *, hot: int = 20_000, shard_rows: int = 20_000) -> DataFrame:
    """``word, n_near, best`` for the words of ``words`` (word, n; distinct) that have near words; ``best`` is the
    most frequent near word as ``(minus_n, word)``, the smallest in code-point order among equals.

    A half that over ``hot`` words share is split further by the rest of the word and by what deleting one character
    leaves of it, so that no group has more than some hundred words for each place; nothing is cut off. A shard has
    about ``shard_rows`` rows, and their number follows that of the words.
    """
    rows = words.select("word", "n", F.explode(_parts()).alias("part")).select("word", "n", "part.key", "part.holds").where(F.length("key") > 1)
    crowded = rows.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("crowded"))
    rest = _rest(F.col("word"), F.col("key"))
    dealt = rows.join(crowded, "key", "left").select(
        "key", "word", "n", "holds", F.explode(F.when(F.col("crowded"), _variants(rest)).otherwise(F.array(F.lit(None).cast("string")))).alias("variant")
    )
    shards = max(1, 4 * words.count() // shard_rows)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "variant"), F.lit(shards)))

    def scan(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("key", "variant", "word", "n", "holds")]
        shard = HalvesShard(list(zip(*columns, strict=True)))
        out: list[tuple[str, int, int, str]] = []
        for word in dict.fromkeys(columns[2]):
            n_near, best = 0, None
            for w, n in shard.near(word):
                n_near += 1
                best = min(best, (-n, w)) if best else (-n, w)
            if best:
                out.append((word, n_near, *best))
        cells = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "minus_n", "other"])

    found = dealt.groupBy("shard").applyInArrow(scan, "word string, n_near long, minus_n long, other string")
    best = F.min(F.struct("minus_n", F.col("other").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows (word, form), a form being at least twice as frequent: steps double until all ends are
    reached, so a chain of k words takes about log2(k) joins."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        after = written(step, "forms")
        drop_table(now)
        now = after.select("word", "root")
        if not after.where("moved").head(1):
            return now


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_chars: int = 5, least_n: int = 3, factor: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of :func:`word_counts`.

    ``form`` is the most frequent word one inserted, deleted or replaced character away (ties: the smallest in
    code-point order) if it is ``factor`` times as frequent, else null; ``root`` follows forms to the last one and is the
    word itself without a form. An empty table gives no rows; nulls are treated as in :func:`word_counts`, other columns
    are not read. ``factor`` must be over 1, or forms could go round in a circle, and a word needs two characters to have halves.
    """
    if factor <= 1 or least_chars < 2:
        raise ValueError("factor must be over 1, least_chars 2 or more")
    words = written(word_counts(docs, id_col=id_col, text_col=text_col, every=every, least_chars=least_chars, least_n=least_n), "words")
    near = near_words(words)
    is_form = -F.col("best.minus_n") >= factor * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
    )
    judged = written(judged, "judged-words")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 (the polynomial of ISO 3309) of a text's UTF-8, bit by bit into a table; ``k`` holds it as ``t``.
CRC_TABLE = "k AS MATERIALIZED (SELECT (SELECT list(list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i)) AS t)"


def crc32_sql(x: str) -> str:
    byte = f"('0x' || hex(encode({x}))[(2 * i + 1):(2 * i + 2)])::BIGINT"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({x}))), lambda i: {byte})), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


#: All words against all by what deleting a character leaves, in DuckDB.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32_sql("s")} AS h FROM c, k),
d AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run) + 2):] ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS MATERIALIZED (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE word[1:(i - 1)] || word[(i + 1):] END AS x FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.x = b.x AND a.word != b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
b AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN g USING (word) JOIN f e ON e.word = g.at WHERE e.form IS NULL
"""
