"""Importance resampling towards a target's n-grams: buckets of hashed features, log ratios, seeded Gumbel noise.

Texts become word ids of a block; a suffix array of the block, sorted as deep as the longest feature, puts equal n-grams
side by side. Where the prefix that neighbours share (LCP) is shorter than n, a run of equal n-grams ends: each run is
hashed once, and its bucket is scattered back to the places it stands at. Counting and scoring both go this way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.memory import released
from quillmesh.llm.spelling_groups import CRC_TABLE, crc32_sql
from quillmesh.llm.store import written

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
#: Longest feature in words; words of a block, whose ids of three words fit into 63 bits.
ORDERS, BLOCK = 3, 1 << 18


def words_of(text: str | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of words of a text, of about ``piece`` bytes each: digits, a-z (A-Z in lower case) and all beyond ASCII."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + piece)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """What ``length`` further bytes make of a checksum: by its four bytes, words that are combined by xor.

    The step is linear but for a constant, so 32 checksums of zero bytes tell all of it.
    """
    zeros = bytes(length)
    nothing = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ nothing for k in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    byte = np.arange(256)
    for k in range(32):
        table[k // 8] ^= np.where(byte >> (k % 8) & 1, bits[k], np.uint32(0))
    return table


class _Hashes:
    """Checksums of n-grams of a block's words, from those of the words."""

    def __init__(self, words: list[bytes]):
        self.first = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.later = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        lengths, self.kind = np.unique([len(w) + 1 for w in words], return_inverse=True)
        self.tables = np.stack([_shift(int(n)) for n in lengths]) if len(words) else np.zeros((1, 4, 256), np.uint32)

    def longer(self, sums: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Checksums after a space and one more word."""
        kind = self.kind[word]
        out = self.later[word].copy()
        for k in range(4):
            out ^= self.tables[kind, k, sums >> np.uint32(8 * k) & np.uint32(255)]
        return out


def buckets_of_block(words: list[bytes], docs: np.ndarray, stop: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the places before ``stop`` at which a feature of it starts, and their buckets.

    ``docs`` tells the document of each word; features don't cross documents.
    """
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    width, end = len(index) + 1, len(words)
    grams = np.zeros((ORDERS, stop), np.int64)  # id + 1 of a feature's words, 0 after the document's end
    for k in range(ORDERS):
        n = min(stop, end - k)
        if n > 0:
            grams[k, :n] = np.where(docs[k : n + k] == docs[:n], ids[k : n + k] + 1, 0)
    order = np.argsort((grams[0] * width + grams[1]) * width + grams[2], kind="stable")  # the suffix array, three words deep
    grams = grams[:, order]
    differs = np.ones((ORDERS, stop), bool)
    differs[:, 1:] = grams[:, 1:] != grams[:, :-1]
    ends = np.logical_or.accumulate(differs)  # ends[k]: the LCP with the suffix before is under k + 1 words
    hashes = _Hashes(list(index))
    for k in range(ORDERS):
        full = grams[k] > 0
        heads = np.flatnonzero(ends[k] & full)
        sums = hashes.first[grams[0, heads] - 1]
        for word in grams[1 : k + 1, heads]:
            sums = hashes.longer(sums, word - 1)
        run = np.cumsum(ends[k] & full) - 1
        yield order[full], (sums % n_buckets).astype(np.int64)[run[full]]


def _blocks(texts, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of all features of the texts, block after block; the last two words of a block begin the next."""
    words: list[bytes] = []
    rows: list[int] = []

    def flushed(stop: int):
        docs = np.array(rows, np.int64)
        for at, buckets in buckets_of_block(words, docs, stop, n_buckets):
            yield docs[at], buckets
        del words[:stop], rows[:stop]

    for row, text in enumerate(texts):
        for piece in words_of(text.as_py()):
            words += piece
            rows += [row] * len(piece)
            if len(words) > BLOCK:
                yield from flushed(len(words) - ORDERS + 1)
    if words:
        yield from flushed(len(words))


def bucket_counts(docs: DataFrame, *, text_col: str = "text", n_buckets: int = 10_000) -> dict[int, int]:
    """Number of features by bucket, over whole texts; null texts have none. At most ``n_buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, buckets in _blocks(batch.column(0), n_buckets):
                total += np.bincount(buckets, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        released()

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], n_buckets: int) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, target to source, rounded down."""
    s_all, t_all = float(sum(source.values()) + n_buckets), float(sum(target.values()) + n_buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(n_buckets)]


def weighed(docs: DataFrame, gain: list[int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` (the sum of gains over a text's features) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(shared.value, np.int64)
        for batch in batches:
            n_words, n_features, weight = np.zeros((3, batch.num_rows), np.int64)
            for k, (rows, buckets) in enumerate(_blocks(batch.column(1), len(gain))):
                n = np.bincount(rows, minlength=batch.num_rows)
                n_features += n
                if k % ORDERS == 0:  # features of one word
                    n_words += n
                np.add.at(weight, rows, gain[buckets])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])
        released()

    out = f"doc_id {kind}, n_words long, n_features long, weight long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def ranked(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in a total order with their ``rank`` (1, 2, 3...), by a sort over all tasks.

    A row's rank is its place in its partition after those of all partitions before; only one count for each partition
    is gathered.
    """
    placed = written(rows.orderBy(*order).select("*", F.spark_partition_id().alias("part_"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at_")), "ranked")
    sizes = sorted((r["part_"], r["count"]) for r in placed.groupBy("part_").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part_ int, before_ long"))
    rank = F.col("before_") + F.col("at_") + 1
    return placed.join(offsets, "part_").withColumn("rank", rank.cast("long")).drop("part_", "at_", "before_").where(F.col("rank") <= n)


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n_buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` for each row of ``docs``; ``rank`` is null where it isn't drawn.

    Features are runs of one to three words, repeats counted. ``score`` is the weight and Gumbel noise from a digest of
    seed and id, so drawing the highest ``percent`` % of documents of ``least_words`` words draws without replacement in
    proportion to exp(weight / 1000), and reruns agree. Ties go to smaller ids, null ids last; a null id's noise is that
    of the empty text. Null and empty texts have no features and weight 0. Repeated rows are drawn each. An empty target
    or an empty table is fine. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col=text_col, n_buckets=n_buckets), bucket_counts(target, text_col=target_text, n_buckets=n_buckets), n_buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighed(docs, gain, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + noise)
    rows = written(rows.withColumn("row_", F.monotonically_increasing_id()), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = ranked(able.select("score", "doc_id", "row_"), [F.desc("score"), F.asc_nulls_last("doc_id"), "row_"], able.count() * percent // 100)
    drawn = drawn.select("row_", "rank").hint("merge")  # it grows with the corpus, so it isn't broadcast
    return rows.join(drawn, "row_", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_FEATURES = r"""
{x}w AS (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w, * FROM {table}),
{x}f AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {x}w) GROUP BY ALL),
"""
#: The same by hashing each distinct feature, in DuckDB.
SQL = rf"""
WITH {CRC_TABLE}, {_FEATURES.format(x="d", table="documents")} {_FEATURES.format(x="b", table="benchmark")}
u AS MATERIALIZED (SELECT f, ({crc32_sql("f")} % 10000)::BIGINT AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), k),
ds AS (SELECT bucket, sum(n) AS s FROM df JOIN u USING (f) GROUP BY bucket), bs AS (SELECT bucket, sum(n) AS t FROM bf JOIN u USING (f) GROUP BY bucket),
z AS (SELECT coalesce((SELECT sum(s) FROM ds), 0)::DOUBLE + 10000 AS s_all, coalesce((SELECT sum(t) FROM bs), 0)::DOUBLE + 10000 AS t_all),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((coalesce(s, 0) + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM range(10000) x(bucket) LEFT JOIN ds USING (bucket) LEFT JOIN bs USING (bucket), z),
q AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN u USING (f) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM dw LEFT JOIN q USING (r)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 5 // 100 THEN rank END::BIGINT AS rank, n_words FROM c LEFT JOIN o USING (r)
"""
