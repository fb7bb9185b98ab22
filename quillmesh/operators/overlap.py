"""Intervals of several producers: a kept one takes out the weaker ones that it meets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.reconcile import overlaps
from quillmesh.plans.store import written

#: Intervals of a slice at first, times as many in each round, and mean lengths in a slice at least.
SLICE, GROWTH, LENGTHS = 2000, 8, 8


class _Slice:
    """What is known of one stretch of the axis, where intervals come strongest first."""

    def __init__(self) -> None:
        self.starts, self.kept = [], []  # kept ones don't overlap, so they are in order of start and end
        self.open_starts, self.open_ends = [], []  # what undecided ones cover, put together

    def strongest(self, start, end) -> tuple | None:
        i = bisect_right(self.starts, start)
        i -= bool(i) and self.kept[i - 1][1] > start
        met = self.kept[i : bisect_left(self.starts, end)]
        return min(met, key=lambda k: k[3]) if met else None

    def is_open(self, start, end) -> bool:
        return bisect_right(self.open_ends, start) < bisect_left(self.open_starts, end)

    def leave_open(self, start, end) -> None:
        i, j = bisect_left(self.open_ends, start), bisect_right(self.open_starts, end)
        if i < j:
            start, end = min(start, self.open_starts[i]), max(end, self.open_ends[j - 1])
        self.open_starts[i:j], self.open_ends[i:j] = [start], [end]

    def keep(self, start, end, name) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.kept.insert(i, (start, end, name, len(self.kept)))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come slice by slice, strongest first. ``state``: 1 kept, 2 replaced, 3 replaced by the given one, null open."""
    at, here = None, None
    for batch in batches:
        cells = zip(*(batch.column(c).to_pylist() for c in ("by_", "slice_", "name", "start", "end", "inside_")))
        states, names, crossing = [], [], []
        for by, cell, name, start, end, inside in cells:
            if (by, cell) != at:
                at, here = (by, cell), _Slice()
            hit, unsure = here.strongest(start, end), here.is_open(start, end)
            if hit:
                sure = inside and not unsure
                states.append(3 if sure else 2)
                names.append(hit[2] if sure else None)
                crossing.append(sure and (start < hit[0] or end > hit[1]))
                continue
            if inside and not unsure:
                here.keep(start, end, name)
            else:
                here.leave_open(start, end)
            states.append(1 if inside and not unsure else None)
            names.append(None)
            crossing.append(False)
        out = [batch.column("name"), pa.array(states, pa.int32()), pa.array(names, batch.column("name").type), pa.array(crossing, pa.bool_())]
        yield pa.RecordBatch.from_arrays(out, names=["name", "state", "replaced_by", "crossing"])


def replace_overlapping(intervals: DataFrame, by: str, strength: Column) -> DataFrame:
    """``intervals`` (``by, name, start, end``; names are unique) with ``kept, replaced_by, crossing``.

    The smallest ``strength`` wins, a total order that it is taken to be with the name: an interval is kept if no kept
    one of its ``by`` that is stronger meets it, so no two kept ones overlap, and one that is itself replaced replaces
    nothing. ``replaced_by`` is the strongest kept interval that it meets; it is ``crossing`` if it reaches beyond it, so
    that a part of it would be lost. Empty intervals and those without a ``by`` meet nothing and are kept.

    The axis of a ``by`` is cut into slices of some :data:`SLICE` intervals, which go through a slice in order of
    strength; no pair is formed. What reaches beyond a slice, or meets a stronger one that is open, is open until it
    meets a kept one. Open ones meet no stronger kept one, so the next round takes them alone, in larger slices; a
    ``by`` of one slice is settled at once.
    """
    rank = F.struct(strength.alias("s"), "name")
    rows = written(intervals.select(by, "name", "start", "end", rank.alias("rank")), "intervals")
    spread = rows.where((F.col("start") < F.col("end")) & F.col(by).isNotNull()).withColumnRenamed(by, "by_")
    name = rows.schema["name"].dataType.simpleString()
    left, decided, size = spread, None, SLICE
    while decided is None or left.head(1):
        length = F.col("end").cast("double") - F.col("start").cast("double")
        axis = left.groupBy("by_").agg(F.min(F.col("start").cast("double")).alias("low_"), F.max(F.col("end").cast("double")).alias("high_"), F.count("*").alias("n_"), F.avg(length).alias("mean_"))
        width = F.when(F.col("n_") > size, F.greatest((F.col("high_") - F.col("low_")) / F.ceil(F.col("n_") / size), LENGTHS * F.col("mean_")))
        cell = lambda c: F.coalesce(F.floor((F.col(c).cast("double") - F.col("low_")) / F.col("width_")), F.lit(0).cast("long"))
        placed = left.join(axis.select("by_", "low_", width.alias("width_")), "by_").withColumns({"first_": cell("start"), "last_": cell("end")})
        placed = placed.withColumn("inside_", F.col("first_") == F.col("last_")).withColumn("slice_", F.explode(F.sequence("first_", "last_")))
        dealt = placed.repartition("by_", "slice_").sortWithinPartitions("by_", "slice_", "rank").select("by_", "slice_", "name", "start", "end", "inside_")
        every = written(dealt.mapInArrow(_decide, f"name {name}, state int, replaced_by {name}, crossing boolean"), "decided")
        found, unsure = every.where("state IS NOT NULL"), every.where("state IS NULL").select("name").distinct()
        decided = found if decided is None else decided.unionByName(found)
        if not unsure.head(1):
            break
        left = written(left.join(unsure.join(found.select("name"), "name", "left_anti"), "name", "left_semi"), "open")
        size *= GROWTH
    # one that reaches over slices may be met in several, and by another kept one in each
    told = decided.where("state != 2")
    part = decided.where("state = 2").select("name").distinct().join(told.where("state = 3").select("name"), "name", "left_anti")
    part = written(part, "replaced")
    if part.head(1):
        side = lambda names: spread.join(names, "name").select(F.col("by_").alias(by), "name", "start", "end")
        met = overlaps(side(part), side(told.where("state = 1").select("name")), by)
        ranks = spread.select(F.col("name").alias("b"), "rank", F.col("start").alias("s_"), F.col("end").alias("e_"))
        best = met.join(ranks, "b").groupBy("a").agg(F.min(F.struct("rank", "s_", "e_", "a_start", "a_end")).alias("x"))
        crossing = (F.col("x.a_start") < F.col("x.s_")) | (F.col("x.a_end") > F.col("x.e_"))
        told = told.unionByName(best.select(F.col("a").alias("name"), F.lit(3).alias("state"), F.col("x.rank.name").alias("replaced_by"), crossing.alias("crossing")))
    marked = told.where("state = 3").select("name", "replaced_by", "crossing")
    return intervals.join(marked, "name", "left").select(*intervals.columns, F.col("replaced_by").isNull().alias("kept"), "replaced_by", F.coalesce("crossing", F.lit(False)).alias("crossing"))
