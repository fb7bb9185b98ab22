"""Mixing of sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Targets come from the weights, with what a source can't give reshared. Blocks of equal token counts go to the sources by
the highest quotients target / (2 k - 1), then to each source's shards in the same way by shard size, and where a source
has more than ``FINE`` shards' worth of words, from those to their parts once more. In a shard or part, documents stand in a seeded order, and their row of
words is cut into blocks. A quota beyond the whole row takes all of it once or twice, and then as many blocks as are left,
those of the lowest seeded ranks; documents get the words of the chosen blocks that lie in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.store import aside, fresh, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
FINE = 4096  # shards that one group of quotients is ranked among, so no window grows with the corpus
RANKED = 1 << 22  # blocks that one task ranks, about
#: Rows up to which a table of sources or shards is broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _bucket(id_col: str, seed: str) -> Column:
    return F.conv(F.substring(_seeded(id_col, seed), 1, 7), 16, 10).cast("long")


def _joined(rows: DataFrame, small: DataFrame, keys: Column) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys)


def apportioned(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: Column) -> DataFrame:
    """``votes`` with ``seats_``: ``seats`` of a group, shared out to its rows by the highest quotients.

    The seat count of a row lies within share * (1 +- rows / 2 seats) +- 1/2; what lies below is given at once, and only
    the quotients in between (at most four times as many as rows) are ranked. Ties go by ``key``.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sized = (
        votes.withColumn("of_", seats.cast("double"))
        .withColumn("share_", F.when(F.sum(vote).over(every) > 0, F.col("of_") * F.col(vote) / F.sum(vote).over(every)).otherwise(F.lit(0.0)))
        .withColumn("slack_", F.when(F.col("of_") > 0, F.col("share_") * F.count("*").over(every) / (2 * F.col("of_"))).otherwise(F.lit(0.0)) + 0.5)
        .withColumn("least_", F.greatest(F.lit(0), F.floor(F.col("share_") - F.col("slack_"))).cast("long"))
        .withColumn("most_", F.ceil(F.col("share_") + F.col("slack_")).cast("long"))
        .withColumn("left_", F.col("of_").cast("long") - F.sum("least_").over(every))
    )
    ranked = (
        sized.where(f"{vote} > 0")
        .withColumn("k_", F.explode(F.sequence(F.col("least_") + 1, F.col("most_"))))
        .withColumn("place_", F.row_number().over(every.orderBy(F.desc(F.col(vote) / (2 * F.col("k_") - 1)), *key, "k_")))
        .where("place_ <= left_")
    )
    on = [*group, *key]
    won = ranked.groupBy(*on).agg(F.count("*").alias("won_"))
    return (
        sized.join(won.select("won_", *(F.col(c).alias(f"{c}__") for c in on)), [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in on], "left")
        .withColumn("seats_", F.col("least_") + F.coalesce("won_", F.lit(0)))
        .drop("of_", "share_", "slack_", "least_", "most_", "left_", "won_", *(f"{c}__" for c in on))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``source, source_size, rank_, all_, target`` (``all_``: the words of the whole mix) of rows ``source, source_size``. Sources go by code point, null last."""
    ranked = sizes.withColumn("rank_", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = (
        ranked.withColumn("weight_", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank_") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap_", F.col("source_size") * F.lit(float(most)))
        .withColumn("all_", F.sum("source_size").over(Window.partitionBy()) * (percent / 100))
    )
    # The sources that reach their cap first come first; a source stops at its cap if the rest, shared out, would pass it.
    order = Window.orderBy(F.col("cap_") / F.col("weight_"), "rank_")
    filled = (
        weighed.withColumn("given_", F.coalesce(F.sum("cap_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_", F.sum("weight_").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped_", F.col("cap_") * F.col("weights_") <= F.col("weight_") * (F.col("all_") - F.col("given_")))
        .withColumn("level_", F.first(F.when(~F.col("capped_"), (F.col("all_") - F.col("given_")) / F.col("weights_")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return filled.select("source", "source_size", "rank_", "all_", F.when(F.col("capped_"), F.col("cap_")).otherwise(F.col("weight_") * F.col("level_")).alias("target"))


RANKS = 2147483647  # a prime: ranks are squares modulo it, and ties go by the block's number


def _salt(*keys: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 7), 16, 10).cast("long")


def _block_rank(block: Column, salt: Column) -> Column:
    """Seeded rank of a block of a shard: one number that orders without ties, as a shard has fewer than 2^31 blocks."""
    x = (block * 48271 + salt + 1) % RANKS
    return (x * x) % RANKS * (RANKS + 1) + block


def _chosen(before: Column, size: Column, last: Column, rest: Column, salt: Column, block_tokens: int) -> Column:
    """Spans ``start, words`` (from 0 in a document) of the chosen blocks that lie in a document.

    The document's words are ``before`` to ``before + size`` of its shard. Blocks ranked below ``last`` are chosen whole,
    ``last`` itself with its first ``rest`` words.
    """
    blocks = F.sequence(F.floor(before / block_tokens), F.floor((before + size - 1) / block_tokens))

    def span(b: Column) -> Column:
        rank = _block_rank(b, salt)
        words = F.when(rank < last, F.lit(block_tokens)).when(rank == last, rest).otherwise(F.lit(0))
        start = F.greatest(b * block_tokens, before)
        return F.struct((start - before).alias("start"), (F.least(b * block_tokens + words, before + size) - start).alias("words"))

    none = F.array().cast("array<struct<start:bigint,words:bigint>>")
    return F.when((size > 0) & last.isNotNull(), F.filter(F.transform(blocks, span), lambda x: x["words"] > 0)).otherwise(none)


_OWN = (
    "source_q", "bucket_", "fine_", "rank_", "rank_q", "all_", "shards_", "shard_", "shard_q", "parts_", "part_", "part_q", "blocks_", "source_blocks_",
    "shard_size_", "seeded_", "before_", "rounds_", "over_", "salt_", "last_",
)


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = 8, shard_words: int = 100_000, seed: str = "mix") -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words of the row in the mix), and
    what they are: ``copies`` whole ones and the ``blocks`` (spans ``start, words``, counted from 0) of one more.

    A null text has size 0 and nothing is taken of it. Null sources form one source, the last. Rows with equal ids stand
    next to each other in the seeded order, the shorter first, and are taken each on their own. An empty table gives an
    empty table; input columns named like those that are added are replaced. No document gives more than twice its size,
    so a shard gives at most twice its words and a source may end below its target by less than two blocks for each shard
    (the end of a quota, and the short last block of the row). A shard's blocks are ranked within one row of the table of
    shards: some ``shard_words / block_tokens`` numbers, more only where one document is longer than a shard.
    """
    given = docs.drop("size", "source_size", "target", "taken", "copies", "blocks")
    docs, moved = aside(given, *_OWN)
    id_col, text_col, source_col = (moved.get(c, c) for c in (id_col, text_col, source_col))
    sized = docs.withColumn("size", n_words(F.col(text_col))).withColumn("bucket_", _bucket(id_col, seed)).withColumn("fine_", (F.col("bucket_") % FINE).cast("int"))
    fine = written(sized.groupBy(F.col(source_col).alias("source"), "fine_").agg(F.sum("size").alias("fine_size")), "mix-shards")
    targets = source_targets(fine.groupBy("source").agg(F.sum("fine_size").alias("source_size")))
    quotas = apportioned(targets, [], ["rank_"], "target", F.floor(F.col("all_") / block_tokens)).withColumnRenamed("seats_", "source_blocks_").drop("all_")
    quotas = quotas.withColumn("shards_", F.greatest(F.lit(1), F.least(F.lit(FINE), F.ceil(F.col("source_size") / shard_words))).cast("int"))
    quotas = written(quotas.withColumn("parts_", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (FINE * shard_words))).cast("long")), "mix-quotas")
    shards = (
        _joined(fine, quotas.withColumnRenamed("source", "source_q"), F.col("source").eqNullSafe(F.col("source_q")))
        .groupBy("rank_", (F.col("fine_") % F.col("shards_")).alias("shard_"))
        .agg(F.sum("fine_size").alias("shard_size_"), F.first("source_blocks_").alias("source_blocks_"))
    )
    shards = apportioned(shards, ["rank_"], ["shard_"], "shard_size_", F.col("source_blocks_")).drop("source_blocks_").withColumnRenamed("seats_", "blocks_")
    placed = _joined(sized, quotas.withColumnRenamed("source", "source_q"), F.col(source_col).eqNullSafe(F.col("source_q")))
    placed = placed.withColumn("shard_", F.col("fine_") % F.col("shards_")).withColumn("part_", F.floor(F.col("bucket_") / FINE) % F.col("parts_"))
    most_parts, all_words = quotas.agg(F.max("parts_"), F.sum("source_size")).first()
    if (most_parts or 1) == 1:
        shards = shards.withColumn("part_", F.lit(0).cast("long"))
    else:
        parts = placed.groupBy("rank_", "shard_", "part_").agg(F.sum("size").alias("part_size_"))
        parts = parts.join(shards.select("rank_", "shard_", "blocks_"), ["rank_", "shard_"])
        shards = apportioned(parts, ["rank_", "shard_"], ["part_"], "part_size_", F.col("blocks_")).select("rank_", "shard_", "part_", F.col("part_size_").alias("shard_size_"), F.col("seats_").alias("blocks_"))
    # A shard's row is small and its ranks are many: tasks follow the blocks, not the bytes that would be merged into one.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (all_words or 0) // (block_tokens * RANKED))
    words = F.least(F.col("blocks_") * block_tokens, 2 * F.col("shard_size_"))
    rounds = F.when(F.col("shard_size_") > 0, F.floor(words / F.col("shard_size_"))).otherwise(F.lit(0)).cast("long")
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size_") - 1) / block_tokens)), lambda n: _block_rank(n, F.col("salt_")))
    shards = (
        shards.select("rank_", "shard_", "part_", "shard_size_", rounds.alias("rounds_"), (words - rounds * F.col("shard_size_")).cast("long").alias("over_"))
        .repartition(tasks, "rank_", "shard_", "part_")
        .withColumn("salt_", _salt(F.lit(seed), "rank_", "shard_", "part_"))
        .withColumn("last_", F.when(F.col("over_") > 0, F.get(F.array_sort(ranks), F.floor(F.col("over_") / block_tokens).cast("int"))))
        .withColumn("over_", F.col("over_") % block_tokens)
    )
    shards = written(shards.withColumnsRenamed({"rank_": "rank_q", "shard_": "shard_q", "part_": "part_q"}), "mix-shard-quotas")
    placed = _joined(placed, shards, (F.col("rank_") == F.col("rank_q")) & (F.col("shard_") == F.col("shard_q")) & (F.col("part_") == F.col("part_q")))
    order = Window.partitionBy("rank_", "shard_", "part_").orderBy("seeded_", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("seeded_", _seeded(id_col, seed + "-order"))
        .withColumn("before_", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
        .withColumn("blocks", _chosen(F.col("before_"), F.col("size"), F.col("last_"), F.col("over_"), F.col("salt_"), block_tokens))
        .withColumn("taken", F.col("rounds_") * F.col("size") + F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
        .select(*(F.col(moved.get(c, c)).alias(c) for c in given.columns), "size", "source_size", "target", "taken", F.col("rounds_").alias("copies"), "blocks")
    )


def written_out(mix: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mix as rows of ``columns``: a row for each whole copy, and one with the chosen blocks of a copy taken in part.

    The words of such a part stand in their order, joined by single spaces; a copy whose blocks were all chosen is whole.
    A document of size 0, and one with a null text, gives no row.
    """
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))

    def joined(blocks: Column) -> Column:
        # The words are the one element of an array: named in a column, they would be taken out again for every block.
        pieces = F.transform(F.array(words), lambda own: F.flatten(F.transform(blocks, lambda x: F.slice(own, (x["start"] + 1).cast("int"), x["words"].cast("int")))))
        return F.array_join(F.get(pieces, F.lit(0)), " ")

    def part(blocks: Column) -> Column:
        whole = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, x: a + x["words"]) == F.col("size")
        return F.when(F.size(blocks) > 0, F.array(F.when(whole, F.col(text_col)).otherwise(joined(blocks)))).otherwise(F.array().cast("array<string>"))

    parts = F.get(F.transform(F.array("blocks"), part), F.lit(0))
    (copy,) = fresh(mix, "copy")
    texts = F.when(F.col("size") > 0, F.concat(F.array_repeat(F.col(text_col), F.col("copies").cast("int")), parts))
    copies = mix.select("*", F.explode_outer(texts).alias(copy)).where(F.col(copy).isNotNull())
    return copies.withColumn(text_col, F.col(copy)).select(*columns)


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % 4096) AS fine,
    md5('mix-order|' || coalesce(doc_id::VARCHAR, '')) AS seeded FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((r - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s),
g AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT *, cap * ws <= w * (total - given) AS capped FROM g),
t AS (SELECT source, source_size, r, CASE WHEN capped THEN cap ELSE w * (SELECT (total - given) / ws FROM l WHERE NOT capped ORDER BY cap / w, r LIMIT 1) END AS target FROM l),
m AS (SELECT *, floor((SELECT any_value(total) FROM w) / 8)::BIGINT AS blocks FROM t),
q AS (SELECT r, k FROM (SELECT r, k, blocks, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, r, k) AS n
    FROM (SELECT *, unnest(range(1, (target / 8 * 1.5 + 30)::BIGINT)) AS k FROM m WHERE target > 0)) WHERE n <= blocks),
a AS (SELECT t.*, (SELECT count(*) FROM q WHERE q.r = t.r) AS seats, greatest(1, least(4096, ceil(source_size / 100000)))::BIGINT AS shards FROM t),
p AS (SELECT d.*, r, source_size, target, seats, fine % shards AS shard FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
z AS (SELECT r, shard, sum(size)::BIGINT AS z, any_value(seats) AS seats FROM p GROUP BY r, shard),
y AS (SELECT r, shard, count(*) AS blocks FROM (SELECT r, shard, seats, row_number() OVER (PARTITION BY r ORDER BY z / (2 * k - 1) DESC, shard, k) AS n
    FROM (SELECT *, unnest(range(1, seats + 1)) AS k FROM z WHERE z > 0)) WHERE n <= seats GROUP BY r, shard),
e AS (SELECT z.r, z.shard, z, least(8 * coalesce(blocks, 0), 2 * z)::BIGINT AS words, ('0x' || substr(md5('mix|' || z.r || '|' || z.shard || '|0'), 1, 7))::BIGINT AS salt FROM z LEFT JOIN y ON z.r = y.r AND z.shard = y.shard),
n AS (SELECT r, shard, b, row_number() OVER (PARTITION BY r, shard ORDER BY x * x % 2147483647, b) AS place
    FROM (SELECT r, shard, b, (b * 48271 + salt + 1) % 2147483647 AS x FROM (SELECT *, unnest(range(0, (z + 7) // 8)) AS b FROM e WHERE z > 0))),
c AS (SELECT n.r, n.shard, b, CASE WHEN place <= (words % z) // 8 THEN 8 WHEN place = (words % z) // 8 + 1 THEN (words % z) % 8 ELSE 0 END AS got FROM n JOIN e ON n.r = e.r AND n.shard = e.shard),
b AS (SELECT p.*, z, words, coalesce(sum(size) OVER (PARTITION BY p.r, p.shard ORDER BY seeded, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM p JOIN e ON p.r = e.r AND p.shard = e.shard),
i AS (SELECT *, unnest(range(before // 8, (before + size - 1) // 8 + 1)) AS blk FROM b WHERE size > 0),
f AS (SELECT i.doc_id, i.r, i.shard, i.seeded, i.before, sum(greatest(0, least(blk * 8 + got, before + size) - greatest(blk * 8, before)))::BIGINT AS part
    FROM i JOIN c ON i.r = c.r AND i.shard = c.shard AND i.blk = c.b GROUP BY ALL)
SELECT b.doc_id, size, source_size, target, (CASE WHEN size > 0 THEN words // z * size + coalesce(part, 0) ELSE 0 END)::BIGINT AS taken
FROM b LEFT JOIN f ON b.doc_id IS NOT DISTINCT FROM f.doc_id AND b.r = f.r AND b.shard = f.shard AND b.before = f.before AND size > 0
"""
