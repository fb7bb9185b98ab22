"""N-gram Jaccard join: count vectors in an R-tree, the overlap bounded by summed coordinate minima.

The shingles of a document are hashed into groups and counted per group. The sum over all groups of the smaller of two
counts bounds the overlap of two documents, and that of two boxes' upper corners the overlap of any points in them.

A tree over the points of a whole corpus can't be searched in few places, so points are first dealt by exact groups. At
a size level, two documents that are similar enough differ in D shingles at most. Shingles are hashed into D + 1 + e
groups, of which e + 1 or more are then the same in both, and each group's content is one key. Documents that share a
key form a family, found with stars instead of pairs. Each family is cut into blocks of bounded size, and each pair of
blocks is searched with a tree over count vectors, whose surviving pairs are verified on the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.components import components
from quillmesh.llm.memory import released
from quillmesh.llm.store import drop_table, fresh, written

_U = np.uint64
GROUPS = 64  # dimensions of a count vector
FANOUT = 16  # points of a leaf and children of a node


_HALF, _ODD = _U(32), _U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look independent."""
    x = x ^ (x >> _HALF)
    x *= _ODD
    x ^= x >> _HALF
    x *= _ODD
    x ^= x >> _HALF
    return x


def _new(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values of a sorted array begins."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def shingles_of(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of a shorter text, the hash of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        out = _mixed(out)
        out += hashed[k : len(words) - size + 1 + k]
    out = np.sort(_mixed(out))
    return out[_new(out)]


class Levels:
    """Size levels of a similarity of ``percent`` / 100: which a document takes part in, and their group counts."""

    def __init__(self, percent: int, ratio: float = 1.35, miss: float = 0.02):
        self.percent, self.ratio, self.miss = percent, ratio, miss
        self.starts = [1]
        self.groups: list[tuple[int, int]] = []

    def _grown(self, size: int) -> None:
        while self.starts[-1] <= size:
            low = self.starts[-1]
            high = max(low + 1, math.ceil(low * self.ratio))
            self.starts.append(high)
            smaller = high - 1
            larger = 100 * smaller // self.percent
            differ = (smaller + larger) * (100 - self.percent) // (100 + self.percent)
            extra = 0
            if differ:  # the fewest that make weak keys rare enough, or as rare as can be
                chance: list[float] = []
                while len(chance) < differ + 6 and not (chance and chance[-1] <= self.miss):
                    chance.append(self._tail(low, differ + 1 + len(chance), len(chance)))
                extra = len(chance) - 1 if chance[-1] <= self.miss else int(np.argmin(chance))
            self.groups.append((differ + 1 + extra, extra))

    @staticmethod
    def _tail(size: int, groups: int, extra: int) -> float:
        """Chance that more than ``extra`` groups are empty (Poisson)."""
        mean = groups * math.exp(-size / groups)
        term, total = math.exp(-mean), 0.0
        for k in range(extra + 1):
            total += term
            term *= mean / (k + 1)
        return 1 - total

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(level, groups, extra) for a document of ``size`` shingles; level's smaller partners start in it."""
        self._grown(size)
        own = next(i for i in range(len(self.starts) - 2, -1, -1) if self.starts[i] <= size)
        out = []
        for level in range(own, -1, -1):
            if level < own and self.percent * size > 100 * (self.starts[level + 1] - 1):
                break
            out.append((level, *self.groups[level]))
        return out


def keys_of(shingles: np.ndarray, levels: Levels, frequent: np.ndarray) -> np.ndarray:
    """The keys of a document: one for each group that holds a shingle that isn't ``frequent`` (sorted), at each level.

    Two documents agree in more than ``extra`` groups. If all of those were weak (empty, or of frequent shingles alone,
    which strangers share), both would have more than ``extra`` weak groups, and then these give keys, too. So which
    shingles count as frequent changes the work, and no result.
    """
    rare = np.ones(len(shingles), np.int64)
    if len(frequent):
        rare = (frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] != shingles).astype(np.int64)
    out = []
    for level, groups, extra in levels.of(len(shingles)):
        if groups == 1:  # no difference is allowed: equal sets alone, which are one node already
            continue
        spread = _mixed(shingles + _U(level))
        at = (spread % _U(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)  # short keys are sorted by radix
        order = np.argsort(at, kind="stable")
        at, spread = at[order], _mixed(spread[order] ^ _U(0x9E3779B97F4A7C15))
        starts = np.flatnonzero(_new(at))
        sums = np.add.reduceat(spread, starts)
        place = at[starts].astype(_U) + (_U(level) << _U(40))
        keys = _mixed(sums ^ _mixed(place + _U(1)))
        strong = np.add.reduceat(rare[order], starts) > 0
        if groups - np.count_nonzero(strong) > extra:
            empty = np.setdiff1d(np.arange(groups), at[starts]).astype(_U) + (_U(level) << _U(40))
            out += [keys, _mixed(_mixed(empty + _U(1)) ^ _U(0x5851F42D4C957F2D))]
        else:
            out.append(keys[strong])
    return np.concatenate(out) if out else np.empty(0, _U)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest node, and an edge from every other node of a key to it."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    starts = np.flatnonzero(_new(keys))
    least = np.minimum.reduceat(nodes, starts) if len(keys) else nodes
    first = np.repeat(least, np.diff(starts, append=len(keys)))
    other = nodes != first
    edges = np.unique(np.stack([nodes[other], first[other]], axis=1), axis=0)
    return keys[starts], least, edges[:, 0], edges[:, 1]


class RTree:
    """Packed tree over count vectors, sorted by size and then by their counts; ``boxes[0]`` are the leaves' boxes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*vectors.T[:4], sizes))
        self.points, self.sizes = vectors[self.order], sizes[self.order]
        upper, least = self.points, self.sizes
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.arange(0, len(upper), FANOUT)
            upper, least = np.maximum.reduceat(upper, starts), np.minimum.reduceat(least, starts)
            self.boxes.append((upper, least))
            if len(upper) == 1:
                break


def _bounded(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Where the summed coordinate minima leave room for the similarity."""
    shared = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2)
    return (100 + percent) * shared >= percent * (a_sizes[:, None] + b_sizes[None, :])


def tree_pairs(a: RTree, b: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in the trees' input) of pairs of points whose bound reaches the similarity, a pair of leaves at a time.

    With ``a is b``, each pair of different points comes once.
    """

    def below(tree: RTree, level: int, at: int) -> range:
        count = len(tree.boxes[level - 1][0]) if level else len(tree.points)
        return range(at * FANOUT, min(at * FANOUT + FANOUT, count))

    stack = [(len(a.boxes) - 1, 0, len(b.boxes) - 1, 0)]
    while stack:
        i, x, j, y = stack.pop()
        if i == j == 0:
            p, q = below(a, 0, x), below(b, 0, y)
            near = _bounded(a.points[p.start : p.stop], b.points[q.start : q.stop], a.sizes[p.start : p.stop], b.sizes[q.start : q.stop], percent)
            if a is b and x == y:
                near = np.triu(near, 1)
            u, v = np.nonzero(near)
            if len(u):
                yield a.order[u + p.start], b.order[v + q.start]
            continue
        p, up = (below(a, i, x), i - 1) if i >= j else (range(x, x + 1), i)
        q, vp = (below(b, j, y), j - 1) if j >= i else (range(y, y + 1), j)
        (high, small), (tall, least) = a.boxes[up], b.boxes[vp]
        near = _bounded(high[p.start : p.stop], tall[q.start : q.stop], small[p.start : p.stop], least[q.start : q.stop], percent)
        if a is b and x == y:
            near = np.triu(near)
        stack.extend((up, p.start + u, vp, q.start + v) for u, v in zip(*np.nonzero(near), strict=True))


class _Forest:
    """Union-find over nodes of a block pair."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def joined(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _tree(side: list[tuple[int, np.ndarray]]) -> RTree:
    vectors = np.stack([np.bincount((s >> _U(58)).astype(np.int64), minlength=GROUPS) for _, s in side]).astype(np.int32)
    return RTree(vectors, np.array([len(s) for _, s in side], np.int64))


def block_links(rows: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links (node, node) that span what is linked among ``rows``, or between ``rows`` and ``others``.

    Pairs that are connected already aren't verified, so a group of copies costs about one look for each.
    """
    own = _tree(rows)
    others, other = (rows, own) if others is None else (others, _tree(others))
    forest, links = _Forest(), []
    for us, vs in tree_pairs(own, other, percent):
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            (x, left), (y, right) = rows[u], others[v]
            if forest.root(x) != forest.root(y) and _alike(left, right, percent):
                forest.joined(x, y)
                links.append((x, y))
    return links


#: Kinds of a row of ``block_counts``: a spanning link, a node's sum, a link of a node that must be known by itself.
SPAN, SUM, EACH = range(3)


class _Overlaps:
    """Exact overlaps of a row with many of the ``others`` at once.

    Shingles that more than one set of 64 has are bits of each set's words, which takes no more room than the shingles
    themselves; the rest are looked up in lists of the others that have them.
    """

    def __init__(self, rows: list[np.ndarray], others: list[np.ndarray]):
        _, at, counts = np.unique(np.concatenate([*rows, *others]), return_inverse=True, return_counts=True)
        self.sizes = np.array([len(s) for s in (*rows, *others)], np.int64)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        often = 64 * counts > len(self.sizes)
        bit = (np.cumsum(often) - 1)[at]
        width = (int(often.sum()) + 63) >> 6
        frequent = often[at]
        self.words = np.zeros(len(self.sizes) * width, _U)
        np.bitwise_or.at(self.words, owner[frequent] * width + (bit[frequent] >> 6), _U(1) << (bit[frequent] & 63).astype(_U))
        self.words = self.words.reshape(len(self.sizes), width)
        self.cut, rare = len(rows), at[~frequent]
        holder = owner[~frequent]
        ours = holder < self.cut
        self.rare = np.split(rare[ours], np.searchsorted(holder[ours], np.arange(1, self.cut)))
        order = np.argsort(rare[~ours], kind="stable")
        self.holders = holder[~ours][order] - self.cut
        self.ends = np.cumsum(np.bincount(rare[~ours], minlength=len(counts)))

    def linked(self, u: int, vs: np.ndarray, percent: int) -> np.ndarray:
        """Those of the distinct places ``vs`` whose sets are similar enough to row ``u``'s."""
        shared = np.bitwise_count(self.words[self.cut + vs] & self.words[u]).sum(axis=1, dtype=np.int64)
        ends = self.ends[self.rare[u]]
        lengths = ends - np.where(self.rare[u] > 0, self.ends[self.rare[u] - 1], 0)
        if total := int(lengths.sum()):
            at = np.arange(total) + np.repeat(ends - np.cumsum(lengths), lengths)
            shared += np.bincount(self.holders[at], minlength=len(self.sizes) - self.cut)[vs]
        return vs[100 * shared >= percent * (self.sizes[u] + self.sizes[self.cut + vs] - shared)]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs by their first place, of some ``most`` pairs at a time."""
    held, n = [], 0

    def grouped() -> Iterator[tuple[int, np.ndarray]]:
        us, vs = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(us, kind="stable")
        found, starts = np.unique(us[order], return_index=True)
        yield from zip(found.tolist(), np.split(vs[order], starts[1:]), strict=True)

    for us, vs in pairs:
        held.append((us, vs))
        n += len(us)
        if n >= most:
            yield from grouped()
            held, n = [], 0
    if held:
        yield from grouped()


def block_counts(rows: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]] | None, percent: int, weights: dict[int, int], each: set[int]) -> list[tuple[int, int, int, int]]:
    """``(kind, a, b, n)``: spanning links, for each node the sum of the ``weights`` of all it links with, links with ``each``.

    Every pair that the trees leave is verified. Sums stand for the links, so rows don't grow with the square of a family.
    """
    own = _tree(rows)
    others, other, base = (rows, own, 0) if others is None else (others, _tree(others), len(rows))
    nodes = [x for x, _ in rows] + [y for y, _ in others] * (base > 0)
    weight = np.array([weights[x] for x in nodes], np.int64)
    single = np.array([x in each for x in nodes], bool)
    sums, component = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    overlaps = _Overlaps([s for _, s in rows], [s for _, s in others])
    out = []
    for u, vs in _gathered(tree_pairs(own, other, percent)):
        near = overlaps.linked(u, vs, percent) + base
        if not len(near):
            continue
        sums[u] += weight[near].sum()
        sums[near] += weight[u]
        out += [(EACH, nodes[u], nodes[v], 0) for v in (near if single[u] else near[single[near]]).tolist()]
        apart = near[component[near] != component[u]]
        if len(apart):
            merged, first = np.unique(component[apart], return_index=True)
            out += [(SPAN, nodes[u], nodes[v], 0) for v in apart[first].tolist()]
            component[np.isin(component, merged)] = component[u]
    return out + [(SUM, nodes[k], nodes[k], int(sums[k])) for k in np.flatnonzero(sums).tolist()]


def _often(seen: list[np.ndarray]) -> bytes | None:
    """Shingles that a thousandth of a batch's documents have (four at least), packed."""
    found, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, _U), np.empty(0))
    return found[counts >= max(4, len(seen) / 1000)].tobytes() or None


def _frequent(profile: DataFrame, most: int = 1 << 18) -> np.ndarray:
    """Sorted shingles that are frequent in most batches; of more than ``most``, those of most batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.as_py(), np.int64))], ["shingle"])

    often = profile.where("often IS NOT NULL").select("often")
    counted = often.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    best = counted.where(F.col("n") >= 0.25 * often.count()).orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(best.column("shingle").to_numpy().astype(np.int64).view(_U))


def _set_hashes(shingles: np.ndarray, bits: int = 63) -> tuple[int, int]:
    """Two hashes of a set of shingles, of ``bits`` bits (not negative) and 64 bits."""
    first, second = (_mixed(shingles ^ _U(k)).sum(dtype=_U) for k in (1, 2))
    return int(first >> _U(64 - bits)), int(second.astype(np.int64))


def _names(classes: DataFrame) -> dict[tuple[int, int, int], int]:
    """Names of their own for the sets that share a first hash with another: negative, so that no other has them.

    Of N sets, about N * N / 2**64 share one: some dozens of 10**10, which is the bound of what comes to the driver.
    """
    shared = classes.groupBy("h1").count().where("count > 1").select("h1")
    rows = sorted(tuple(r) for r in classes.join(shared, "h1").select("n_shingles", "h1", "h2").collect())
    return {row: -1 - k for k, row in enumerate(rows)}


def _renamed(df: DataFrame, names: dict[tuple[int, int, int], int]) -> DataFrame:
    """``df`` with the names in place of the first hash of these sets."""
    if not names:
        return df
    table = df.sparkSession.createDataFrame([(*row, name) for row, name in names.items()], "n_shingles long, h1 long, h2 long, name_ long")
    named = df.join(F.broadcast(table), ["n_shingles", "h1", "h2"], "left")
    return named.withColumn("h1", F.coalesce("name_", "h1")).select(*df.columns)


def _profiled(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` of each row, and the batch's frequent shingles with its first row; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [shingles_of(text.as_py(), n) for text in batch.column(1)]
            hashes = [_set_hashes(s, bits) for s in seen]
            often = [_often(seen), *[None] * len(seen)][: len(seen)]
            columns = ([len(s) for s in seen], [h for h, _ in hashes], [h for _, h in hashes])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(often, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "often"])
        released()

    return written(docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, often binary"), "profiles")


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each id in a filter of 2 ** ``bits`` bits."""
    mixed = _mixed(ids.astype(np.int64).view(_U))
    return [(mixed >> _U(k * 20)) % _U(1 << bits) if k else mixed >> _U(64 - bits) for k in range(3)]


def _filter_of(ids: DataFrame, most_bits: int = 27) -> np.ndarray:
    """Bloom filter of the ids (one bigint column) as bytes, about sixteen bits for each and 16 MB at most.

    Beyond some 8 million ids the filter fills and lets more through that aren't meant; it never holds one back, and
    the join after it is exact, so a full filter costs shuffled texts and no result.
    """
    bits = min(most_bits, max(10, math.ceil(math.log2(16 * max(1, ids.count())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array((1 << (at & 31)))], ["word", "bits"])

    words = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 5)), np.uint32)
    out[words.column("word").to_numpy().astype(np.int64)] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _passes(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = int(len(filter_)).bit_length() - 1 + 5
    ok = np.ones(len(ids), bool)
    for at in _places(ids, bits):
        at = at.astype(np.int64)
        ok &= (filter_[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
    return ok


def _may_be_in(ids: DataFrame, column: str) -> Column:
    """Whether a column's value may be among the ids; only that column goes through Python."""
    shared = ids.sparkSession.sparkContext.broadcast(_filter_of(ids))

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        return pd.Series(_passes(shared.value, values.to_numpy()))

    return passes(F.coalesce(F.col(column).cast("long"), F.lit(0)))


def _dealt(members: DataFrame, percent: int, block_shingles: int, block_rows: int | None) -> DataFrame:
    """``members`` (``family, node, n_shingles``) with their ``block`` and the blocks that it ``meets``, its own too.

    A family of one block meets itself. Of a larger one, sets are dealt by size first, in steps of the similarity: sets
    of steps further apart than one differ too much in size to link, so these blocks never meet.
    """

    def blocks() -> Column:
        n = F.ceil(F.sum("n_shingles") / block_shingles)
        n = F.greatest(n, F.ceil(F.count("*") / block_rows)) if block_rows else n
        return F.least(n, F.count("*")).cast("long")

    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else math.log(1.25)
    large = members.groupBy("family").agg(blocks().alias("n_")).where("n_ > 1").select("family", F.lit(True).alias("large_"))
    sized = members.join(large, "family", "left").withColumn("step_", F.when(F.col("large_"), F.floor(F.log("n_shingles") / step)).otherwise(F.lit(0)).cast("long"))
    steps = written(sized.groupBy("family", "step_").agg(blocks().alias("own_")), "steps")
    beside = lambda by, name: steps.select("family", (F.col("step_") + by).alias("step_"), F.col("own_").alias(name))
    steps = steps.join(beside(1, "below_"), ["family", "step_"], "left").join(beside(-1, "above_"), ["family", "step_"], "left")
    code = lambda by, k: (F.col("step_") + by) * (1 << 32) + k
    every = lambda by, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: code(by, k))).otherwise(F.array().cast("array<bigint>"))
    meets = F.concat(every(0, "own_"), every(-1, "below_"), every(1, "above_")).alias("meets")
    return sized.join(steps, ["family", "step_"]).select(*members.columns, code(0, F.pmod(F.xxhash64("node"), F.col("own_"))).alias("block"), meets)


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block_shingles: int = 1 << 20, block_rows: int | None = None, round_shingles: int | None = None, flush: int = 1 << 20, count_links: bool = False, name_bits: int = 63) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest id that links reach, itself included.

    Two documents link when 100 * shared >= percent * joint shingles. ASCII letters count in lower case. A null or empty
    text has no shingles and links with nothing; of fewer than ``n`` words the whole sequence is the one shingle. Rows
    of the same id are one node and link if either links. Rows with a null id stay alone with a null component. Equal
    sets are one node, so copies cost nothing after the keys. Nothing is capped: large families are cut into blocks of
    about ``block_shingles`` shingles (and ``block_rows`` sets, if given, so that many short ones don't gather in a
    task), by size first, and every pair of blocks whose sizes allow a link is searched, in as many rounds as keep what
    is shuffled at once to ``round_shingles`` (half the corpus's, if not given). Shingles and keys are compared by 64-bit
    hashes, equal sets by two of them; sets are named by the first (``name_bits`` bits of it), and the few that share it get
    names of their own. The list of frequent shingles is gathered from all batches and bounded. Texts are read three times and never shuffled.

    With ``count_links``, also ``n_links`` (long): the other ids that a document links with itself, of equal texts too
    (0 without words or id). All pairs that the trees leave are then verified, also those that are connected already.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = ["n_shingles", "h1", "h2"]
    profile = _profiled(docs, n, name_bits)
    classes = written(profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("first_id")), "classes")
    names = _names(classes)
    classes, profile = _renamed(classes, names), _renamed(profile, names)

    def name_of(shingles: np.ndarray) -> int:
        h1, h2 = _set_hashes(shingles, name_bits)
        return names.get((len(shingles), h1, h2), h1)

    frequent = spark.sparkContext.broadcast(_frequent(profile))
    profile = profile.drop("often")
    # Tasks that gather keys hold a bounded number of shingles each, however many partitions the session asks for.
    n_shingles = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shingles >> 21)

    # An id with several sets is one node: its sets are tied together.
    several = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a != z").select("doc_id", "a")
    if count_links:
        many = written(profile.where("n_shingles > 0").join(several.select("doc_id"), "doc_id").select("doc_id", "h1").distinct(), "several-sets")
        ids = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1").distinct().groupBy("h1").agg(F.count("*").alias("n_"))
        ids = ids.join(many.groupBy("h1").agg(F.count("*").alias("many_")), "h1", "left")
        weights = written(ids.select("h1", (F.col("n_") - F.coalesce("many_", F.lit(0))).alias("weight"), F.col("many_").isNotNull().alias("each")), "weights")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(percent)
        names = ["part", "keys", "nodes"]

        def packed(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
            flat = np.concatenate(keys)
            flat, owners, a, b = _stars(flat, np.repeat(np.array(nodes, np.int64), [len(k) for k in keys]))
            at = (flat % _U(parts)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            found, starts = np.unique(at[order], return_index=True)
            flat, owners = np.split(flat[order], starts[1:]), np.split(owners[order], starts[1:])
            rows = [(int(p), k.tobytes(), o.tobytes()) for p, k, o in zip(found, flat, owners, strict=True)]
            if len(a):
                rows.append((-1, a.tobytes(), b.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

        keys: list[np.ndarray] = []
        nodes: list[int] = []
        seen: set[int] = set()
        held = 0
        for batch in batches:
            for text in batch.column(0):
                shingles = shingles_of(text.as_py(), n)
                node = name_of(shingles)
                if not len(shingles) or node in seen:
                    continue
                own = keys_of(shingles, levels, frequent.value)
                seen.add(node)
                if len(own):
                    keys.append(own)
                    nodes.append(node)
                    held += len(own)
                if held >= flush:
                    yield packed(keys, nodes)
                    keys, nodes, held = [], [], 0
                    seen.clear()
        if held:
            yield packed(keys, nodes)
        released()

    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, edges = [], [], []
        for batch in batches:
            for part, k, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    edges.append(np.stack([np.frombuffer(k, np.int64), np.frombuffer(o, np.int64)], axis=1))
                else:
                    keys.append(np.frombuffer(k, _U))
                    nodes.append(np.frombuffer(o, np.int64))
        if keys:
            _, _, a, b = _stars(np.concatenate(keys), np.concatenate(nodes))
            edges.append(np.stack([a, b], axis=1))
        if edges:
            found = np.unique(np.concatenate(edges), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        keys, nodes, edges = [], [], []
        released()

    stars = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(keyed, "part int, keys binary, nodes binary").repartition(parts // 4, "part").mapInArrow(starred, "a long, b long")
    families = written(components(written(stars, "stars")), "families")

    members = families.join(classes.select(F.col("h1").alias("node"), "n_shingles", "first_id"), "node").withColumnRenamed("component", "family")
    extra = ["weight", "each"] if count_links else []
    if count_links:
        members = members.join(weights.withColumnRenamed("h1", "node"), "node")
    members = written(_dealt(members, percent, block_shingles, block_rows), "members")
    # What the pairs of blocks move at once is held to half the corpus's shingles, however large a family is.
    moved = members.agg(F.coalesce(F.sum(F.col("n_shingles") * F.size("meets")), F.lit(0))).first()[0]
    rounds = math.ceil(moved / (round_shingles or max(1 << 24, n_shingles // 2))) or 1
    wanted = spark.sparkContext.broadcast(_filter_of(members.select("first_id")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(wanted.value, batch.column(0).to_numpy())))
            seen = [shingles_of(text.as_py(), n) for text in batch.column(1)]
            hashes = pa.array([name_of(s) for s in seen], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, pa.array([s.tobytes() for s in seen], pa.binary())], ["first_id", "node", "shingles"])
        released()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, others, out = None, [], [], []

        def ended() -> None:
            if key is not None and rows and (key[1] == key[2] or others):
                out.extend(block_links(rows, None if key[1] == key[2] else others, percent))

        def links() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for family, i, j, block, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (family, i, j):
                    ended()
                    key, rows, others = (family, i, j), [], []
                (rows if block == i else others).append((node, np.frombuffer(data, _U)))
            yield links()
            out.clear()
        ended()
        yield links()
        rows, others = [], []
        released()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, others, weight, each, out = None, [], [], {}, set(), []

        def ended() -> None:
            if key is not None and rows and (key[1] == key[2] or others):
                out.extend(block_counts(rows, None if key[1] == key[2] else others, percent, weight, each))

        def found() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "a", "b", "n"])

        for batch in batches:
            for family, i, j, block, node, data, w, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (family, i, j):
                    ended()
                    key, rows, others, weight, each = (family, i, j), [], [], {}, set()
                if node in weight:  # a row that repeats id and text
                    continue
                (rows if block == i else others).append((node, np.frombuffer(data, _U)))
                weight[node] = w
                if e:
                    each.add(node)
            yield found()
            out.clear()
        ended()
        yield found()
        rows, others = [], []
        released()

    texts = docs.where("doc_id IS NOT NULL").mapInArrow(shingled, "first_id long, node long, shingles binary")
    held = texts.join(members.drop("n_shingles"), ["first_id", "node"]).select("family", "block", "node", "shingles", *extra, "meets")
    if rounds > 1:
        held = written(held, "shingles")
    pairs = held.select("family", "block", "node", "shingles", *extra, F.explode("meets").alias("k"))
    pairs = pairs.select("family", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "shingles", *extra)
    run, kind = (counted, "kind long, a long, b long, n long") if count_links else (searched, "a long, b long")

    def found_in(k: int) -> DataFrame:
        some = pairs.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(rounds)) == k) if rounds > 1 else pairs
        some = some.repartition(F.col("family"), F.col("i"), F.col("j")).sortWithinPartitions("family", "i", "j")
        return written(some.mapInArrow(run, kind), "found")

    found = reduce(DataFrame.union, map(found_in, range(rounds)))
    if rounds > 1:
        drop_table(held)
    links = found.where(F.col("kind") == SPAN).select("a", "b") if count_links else found

    ties = profile.where("n_shingles > 0").join(several, "doc_id").select("a", F.col("h1").alias("b")).where("a != b")
    tied = written(components(links.union(ties)), "components").select(F.col("node").alias("h1"), "component")
    named = classes.select("h1", "first_id").join(tied, "h1").groupBy("component").agg(F.min("first_id").alias("least"))
    labels = tied.join(named, "component").select("h1", "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "first_id", "doc_id")).alias("component_id")
    if not count_links:
        placed = profile.join(classes, sets, "left").join(labels, "h1", "left")
        return placed.select("doc_id", "n_shingles", component)

    # Ids with one set are counted by their classes' sums, ids with several by themselves, so none counts twice.
    each = found.where(F.col("kind") == EACH)
    near = each.select("a", "b").union(each.select("b", "a")).union(weights.where("each").select("h1", "h1"))
    by_sum = found.where(F.col("kind") == SUM).groupBy(F.col("a").alias("h1")).agg(F.sum("n").alias("sum_"))
    by_many = near.join(many, F.col("b") == F.col("h1")).select("a", "doc_id").distinct().groupBy(F.col("a").alias("h1")).agg(F.count("*").alias("many_"))
    count = F.col("weight") - 1 + F.coalesce("sum_", F.lit(0)) + F.coalesce("many_", F.lit(0))
    labels = weights.join(labels, "h1", "left").join(by_sum, "h1", "left").join(by_many, "h1", "left").select("h1", "least", count.alias("count_"))
    around = many.join(near, F.col("h1") == F.col("a")).select("doc_id", F.col("b").alias("h1")).distinct()
    ones = around.join(weights, "h1").groupBy("doc_id").agg(F.sum("weight").alias("ones_"))
    others = around.join(many.withColumnRenamed("doc_id", "other_"), "h1").select("doc_id", "other_").distinct().groupBy("doc_id").agg((F.count("*") - 1).alias("others_"))
    apart = ones.join(others, "doc_id").select("doc_id", (F.col("ones_") + F.col("others_")).alias("apart_"))
    placed = profile.join(classes, sets, "left").join(labels, "h1", "left").join(apart, "doc_id", "left")
    n_links = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), 0).otherwise(F.coalesce("apart_", "count_")).cast("long")
    return placed.select("doc_id", "n_shingles", component, n_links.alias("n_links"))


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` but one document of each group of linked ones: that of the smallest id stays.

    Rows that repeat the id that stays all stay, as do rows with a null id or without words.
    """
    groups = written(linked(docs, id_col=id_col, text_col=text_col, **options).where("doc_id IS NOT NULL AND component_id != doc_id").select(F.col("doc_id").alias("gone_")).distinct(), "near-copies")
    # Few texts take part in the join; the filter lets all that may be meant through.
    maybe, gone = fresh(docs, "maybe", "gone")
    groups = groups.withColumnRenamed("gone_", gone)
    marked = docs.withColumn(maybe, _may_be_in(groups, id_col))
    left = marked.where(F.col(maybe)).join(groups, F.col(id_col) == F.col(gone), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(left).drop(maybe)


#: The contract's links by brute force in DuckDB, for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
c AS (SELECT a AS doc_id, a AS r FROM l UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.r)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(r) AS m FROM c GROUP BY doc_id) USING (doc_id)
"""

#: The same with the number of links of each document.
LINKS_SQL = f"SELECT c.*, coalesce(n, 0)::BIGINT AS n_links FROM ({SQL}) c LEFT JOIN (SELECT a, count(*) AS n FROM ({SQL.replace(SQL[SQL.index('SELECT s.doc_id, len(s)') :], 'SELECT a, b FROM l')}) GROUP BY a) k ON k.a = c.doc_id"
