"""The one step that depends on its own earlier results: candidates are judged in order, next to the last source found."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quillmesh.plans.rules import THRESHOLDS, Thresholds

CANDIDATE = "struct<source_index:int,score:double,literal:double>"
RESULT = "index int, status string, source_index int, score double, contextual boolean, candidates array<" + CANDIDATE + ">"


def _reordered(found: list[dict], previous: int | None, t: Thresholds) -> tuple[list[dict], bool]:
    """Candidates with the nearest good one after the previous source in front, or those far before it marked down."""
    if previous is None or not found:
        return found, False
    floor = max(t.near_score, found[0]["score"] - t.near_margin)
    near = [c for c in found if 0 <= c["source_index"] - previous <= t.near_blocks and c["score"] >= floor]
    if near:
        chosen = min(near, key=lambda c: (c["source_index"] - previous, -c["score"]))
        bonus = t.close_bonus if chosen["source_index"] - previous <= t.close_blocks else t.near_bonus
        raised = chosen | {"score": round(min(1.0, chosen["score"] + bonus), 4)}
        return [raised, *(c for c in found if c is not chosen)], True
    lowered = [c | {"score": round(max(0.0, c["score"] - t.behind_penalty), 4)} if c["source_index"] < previous - t.behind_blocks else c for c in found]
    return sorted(lowered, key=lambda c: (-c["score"], -c["literal"], c["source_index"])), False


def fold(rows: list[dict], t: Thresholds = THRESHOLDS) -> list[dict]:
    """Status of each block of one target, in order. Rows have ``index, kind, structural, n_chars, blocked, figure``,
    ``wording`` and ``candidates``; ``blocked`` lists the candidates that may not replace the block as a whole."""
    previous, out = None, []
    for row in rows:
        if row["figure"] is not None:
            figures = [i for i in row["figure"] if previous is not None and previous < i <= previous + 5]
            if len(figures) == 1:
                previous = figures[0]
                out.append({"index": row["index"], "status": "ready", "source_index": previous, "score": 1.0, "contextual": False, "candidates": []})
            continue
        found, contextual = _reordered(list(row["candidates"]), previous, t)
        best = found[0] if found else None
        result = {"index": row["index"], "source_index": None, "score": best["score"] if best else 0.0, "contextual": contextual, "candidates": found}
        if row["structural"]:
            if best and best["score"] >= t.heading_context:
                previous = best["source_index"]
            if row["wording"]:
                out.append(result | {"status": "wording", "score": 1.0, "candidates": []})
            continue
        threshold = t.table if row["kind"] == "table" else t.short_paragraph if row["n_chars"] < t.short_chars else t.paragraph
        if contextual and row["kind"] == "paragraph":
            threshold = min(threshold, t.context_paragraph)
        if best and best["score"] >= threshold and best["source_index"] not in row["blocked"]:
            previous = best["source_index"]
            out.append(result | {"status": "ready", "source_index": previous})
        else:
            out.append(result | {"status": "wording" if row["wording"] else "review"})
    return out


def folded(blocks: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """:func:`fold` for each document: one group is one document, whose blocks need each other's results.

    Needs ``doc`` and the columns of :func:`fold`; gives ``doc`` and its results.
    """
    kinds = StructType([StructField("doc", blocks.schema["doc"].dataType), *StructType.fromDDL(RESULT).fields])
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows = None, []

        def done() -> list[dict]:
            return [{"doc": doc} | r for r in fold(rows, t)]

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if rows and row["doc"] != doc:
                    found += done()
                    rows = []
                doc = row["doc"]
                rows.append(row | {"candidates": row["candidates"] or [], "blocked": set(row["blocked"] or [])})
            yield pa.RecordBatch.from_pylist(found, schema=out)
        yield pa.RecordBatch.from_pylist(done(), schema=out)

    # The blocks of a document are one stretch of a task, in order; nothing is made anew for each document.
    return blocks.repartition("doc").sortWithinPartitions("doc", "index").mapInArrow(run, kinds)


def gathered(candidates: DataFrame) -> DataFrame:
    """``doc, index, candidates``: the candidates of a block in the order of their rank, scores to four places."""
    one = F.struct("rank", F.col("source_index").cast("int").alias("source_index"), F.round("score", 4).alias("score"), F.round("literal", 4).alias("literal"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda c: F.struct(c["source_index"], c["score"], c["literal"]).cast(CANDIDATE))
    return candidates.groupBy("doc", "index").agg(listed.alias("candidates"))
