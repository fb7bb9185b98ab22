"""Suffix-array deduplication: suffixes ordered through ``length`` bytes alone by most-significant-digit radix passes.

Equal groups after the last pass are exactly the repeated windows of ``length`` bytes. The first pass deals suffixes out
by a digit taken from their content: the smallest hash of the 18-byte grams inside a window (its anchor). Equal windows
have equal anchors, and neighbouring windows mostly share one, so an anchor stands for a stretch of windows. A stretch
whose bytes also stand around an anchor in a smaller document is settled at once. Windows of a stretch whose anchor, and
no more, is known from a smaller document go through the further passes, eight bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.store import written

_U = np.uint64
GRAM = 18
SEGMENT = 1 << 20  # bytes hashed at a time; longer documents go in overlapping pieces
_BASE = 0x9E3779B97F4A7C15 | 1
#: A stretch of windows [first, first + count) of a document; ``key`` is its anchor's hash, ``print`` its bytes' hash.
STRETCH = np.dtype([("key", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("first", "<i8"), ("count", "u1"), ("place", "u1")])
#: A request for a stretch's bytes; ``wide`` asks for single windows, as very many stretches share the anchor.
REQUEST = np.dtype([("key", "<u8"), ("first", "<i8"), ("count", "u1"), ("wide", "u1")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTES = _mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, _U)])
            self.down = np.cumprod(np.r_[_U(1), np.full(n - 1, inverse, _U)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def packed(rows: np.ndarray) -> bytes:
    """Records column of bytes by column of bytes, which the shuffle's compression likes."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    one = _BYTES[raw]
    n = len(one) - GRAM + 1

    def doubled(h: np.ndarray, size: int) -> np.ndarray:
        return h[:-size] * _U(pow(_BASE, size, 1 << 64)) + h[size:]

    two = doubled(one, 1)
    sixteen = doubled(doubled(doubled(two, 2), 4), 8)
    return _mixed(sixteen[:n] * _U(pow(_BASE, 2, 1 << 64)) + two[16 : 16 + n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def stretches(texts: list[bytes], docs: list[int], length: int = 50) -> np.ndarray:
    """Stretches of all windows of the texts, which hold ``SEGMENT`` bytes in all or are pieces of that size."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(raw) < length:
        return np.empty(0, STRETCH)
    hashes = _gram_hashes(raw)
    bits = _U(len(raw).bit_length())
    least = _sliding_least((hashes >> bits << bits) | np.arange(len(hashes), dtype=_U), length - GRAM + 1)
    anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    at = np.arange(len(anchor))
    owner = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[owner]
    new = inside & (np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = at[new]
    group = np.cumsum(new)
    count = np.bincount(group[inside], minlength=len(first) + 1)[1:]
    up, down = _powers.of(len(raw) + 1)
    sums = np.r_[_U(0), np.cumsum(_mixed(_BYTES[raw]) * up[:-1])]
    out = np.empty(len(first), STRETCH)
    out["key"] = hashes[anchor[first]]
    out["doc"] = np.array(docs, np.int64)[owner[first]]
    out["first"] = first - (ends - sizes)[owner[first]]
    out["count"] = count
    out["place"] = anchor[first] - first
    shape = (out["count"].astype(_U) << _U(8)) | out["place"]
    out["print"] = _mixed(((sums[first + count + length - 1] - sums[first]) * down[first]) ^ _mixed(shape + _U(1)))
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (key, print, doc), and where a smaller document has the same key and print."""
    rows = rows[np.lexsort((rows["doc"], rows["print"], rows["key"]))]
    new = _starts(rows["key"], rows["print"])
    smallest = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else rows["doc"]
    return rows, rows["doc"] > smallest


def equal_windows(contexts: np.ndarray, groups: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which rows' windows (``length`` bytes each) stand in a smaller document of the same group, by radix passes."""
    width = -(-length // 8)
    digits = np.zeros((len(contexts), width * 8), np.uint8)
    digits[:, :length] = contexts
    digits = digits.view(">u8").astype(_U)
    order, group = np.arange(len(contexts)), groups
    for k in range(width):
        digit = digits[order, k]
        by = np.lexsort((digit, group))
        order, group, digit = order[by], group[by], digit[by]
        group = np.cumsum(_starts(group, digit))
        many = np.bincount(group)[group] > 1  # suffixes alone in their group are in place
        order, group = order[many], group[many]
    gone = np.zeros(len(contexts), bool)
    if len(order):
        starts = np.flatnonzero(_starts(group))
        smallest = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.r_[starts, len(order)]))
        gone[order] = docs[order] > smallest
    return gone


def _dealt(key: np.ndarray, rows: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Rows packed by ``key`` modulo ``parts``."""
    if not len(rows):
        return []
    at = (_mixed(key.astype(_U)) % _U(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    found, starts = np.unique(at[order], return_index=True)
    return [(int(p), packed(r)) for p, r in zip(found, np.split(rows[order], starts[1:]), strict=True)]


def _blobs(rows: list[tuple], kinds: str, names: list[str]) -> pa.RecordBatch:
    types = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names)


_SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])
_ASKED = np.dtype([("doc", "<i8"), *((n, REQUEST[n].str) for n in REQUEST.names)])


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _SPAN)
    out["doc"], out["start"], out["end"] = doc, start, end
    return out


def _by_document(data: list[bytes], kind: np.dtype) -> list[tuple[int, bytes]]:
    """One packed row of records (without their id) for each document."""
    if not data:
        return []
    rows = np.concatenate([unpacked(d, kind) for d in data])
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    starts = np.flatnonzero(_starts(rows["doc"]))
    rest = list(kind.names[1:])
    return [(int(r["doc"][0]), packed(np.ascontiguousarray(r[rest]).astype(np.dtype([(n, kind[n].str) for n in rest])))) for r in np.split(rows, starts[1:])]


def _gathered(blobs: DataFrame, parts: int, name: str) -> DataFrame:
    """Blobs (part, spans, asked) gathered by document: ``node, spans, asked``, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, asked = [], []
        for batch in batches:
            for _, s, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans += [s] if s else []
                asked += [a] if a else []
        rows = [(d, s, None) for d, s in _by_document(spans, _SPAN)] + [(d, None, a) for d, a in _by_document(asked, _ASKED)]
        for at in range(0, len(rows), 4096):
            yield _blobs(rows[at : at + 4096], "lbb", ["node", "spans", "asked"])

    return written(blobs.repartition(parts // 4, "part").mapInArrow(run, "node long, spans binary, asked binary"), name)


def repeated_spans(docs: DataFrame, *, length: int = 50, wide_from: int = 2048, flush: int = 1 << 20) -> DataFrame:
    """``node, spans`` (packed start and end pairs, in one or more rows for each document) of ``doc_id long, text``."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    # a partition is held in memory, so there is one for each 16 MB of text, however many the session asks for
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 24)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        texts: list[bytes] = []
        ids: list[int] = []
        held = size = 0

        def done() -> pa.RecordBatch:
            rows, gone = settled(np.concatenate(found))  # copies within the batch need not travel
            out = [(p, b, None) for p, b in _dealt(rows["key"][~gone], rows[~gone], parts)]
            gone = rows[gone]
            spans = _spans(gone["doc"], gone["first"], gone["first"] + gone["count"] + length - 1)
            out += [(p, None, b) for p, b in _dealt(spans["doc"], spans, parts)]
            return _blobs(out, "ibb", ["part", "stretches", "spans"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                if len(raw) > SEGMENT:
                    for at in range(0, len(raw) - length + 1, SEGMENT):
                        piece = stretches([raw[at : at + SEGMENT + length - 1]], [doc], length)
                        piece["first"] += at
                        found.append(piece)
                        held += len(piece)
                else:
                    texts.append(raw)
                    ids.append(doc)
                    size += len(raw)
                if size > SEGMENT:
                    found.append(stretches(texts, ids, length))
                    held += len(found[-1])
                    texts, ids, size = [], [], 0
                if held >= flush:
                    yield done()
                    found, held = [], 0
        if texts:
            found.append(stretches(texts, ids, length))
        if found:
            yield done()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, spans = [], []
        for batch in batches:
            for part, rows, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows:
                    data.append(unpacked(rows, STRETCH))
                if own:
                    spans.append((part, own, None))
        if data:
            rows, gone = settled(np.concatenate(data))
            full, rest = rows[gone], rows[~gone]
            whole = _spans(full["doc"], full["first"], full["first"] + full["count"] + length - 1)
            spans += [(p, b, None) for p, b in _dealt(whole["doc"], whole, parts)]
            # What is left of a key has a document of its own for each print; with two documents it must be looked into.
            new = _starts(rest["key"])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            mixed = (np.minimum.reduceat(rest["doc"], starts) < np.maximum.reduceat(rest["doc"], starts))[group]
            wide = (np.bincount(group) >= wide_from)[group]
            asked = np.empty(int(mixed.sum()), _ASKED)
            for n in ("doc", "key", "first", "count"):
                asked[n] = rest[n][mixed]
            asked["wide"] = wide[mixed]
            spans += [(p, None, b) for p, b in _dealt(asked["doc"], asked, parts)]
        for at in range(0, len(spans), 4096):
            yield _blobs(spans[at : at + 4096], "ibb", ["part", "spans", "asked"])

    first = docs.select("doc_id", "text").mapInArrow(hashed, "part int, stretches binary, spans binary")
    # Spans of batches don't depend on keys; they pass through to where documents are gathered.
    first = first.repartition(parts // 4, "part").mapInArrow(compared, "part int, spans binary, asked binary")
    settled_rows = _gathered(written(first, "stretches"), parts, "settled-spans")

    window = length
    most = window + length - GRAM  # bytes of the longest stretch
    context = np.dtype([("key", "<u8"), ("doc", "<i8"), ("first", "<i8"), ("count", "u1"), ("bytes", "u1", (most,))])

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0

        def done() -> pa.RecordBatch:
            rows = np.concatenate(found)
            return _blobs(_dealt(rows["key"], rows, parts), "ib", ["part", "contexts"])

        for batch in batches:
            for text, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + bytes(most), np.uint8)
                asked = unpacked(data, REQUEST)
                near, far = asked[asked["wide"] == 0], asked[asked["wide"] == 1]
                single = np.repeat(far, far["count"])
                single["first"] += np.arange(len(single)) - np.repeat(np.cumsum(far["count"].astype(np.int64)) - far["count"], far["count"])
                single["count"] = 1
                every = np.concatenate([near, single])
                rows = np.zeros(len(every), context)
                for n in ("key", "first", "count"):
                    rows[n] = every[n]
                rows["doc"] = doc
                at = np.arange(most)
                rows["bytes"] = raw[every["first"][:, None] + at] * (at < every["count"][:, None].astype(np.int64) + length - 1)
                if len(single):  # a window's own digits deal it out
                    wide = np.arange(len(near), len(every))
                    sums = (_mixed(_BYTES[rows["bytes"][wide, :length]]) * _powers.of(length)[0]).sum(axis=1, dtype=_U)
                    rows["key"][wide] = _mixed(sums ^ rows["key"][wide])
                found.append(rows)
                held += len(rows)
                if held * context.itemsize >= 16 * flush:
                    yield done()
                    found, held = [], 0
        if found:
            yield done()

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [unpacked(c, context) for batch in batches for c in batch.column(1).to_pylist()]
        if not data:
            return
        rows = np.concatenate(data)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        new = _starts(rows["key"])
        ends = np.r_[np.flatnonzero(new)[1:], len(rows)]
        at, out = 0, []
        windows = np.cumsum(rows["count"].astype(np.int64))
        while at < len(rows):  # whole groups of about a hundred thousand windows
            done = windows[at - 1] if at else 0
            stop = int(ends[min(np.searchsorted(windows[ends - 1], done + 100_000), len(ends) - 1)])
            part, group = rows[at:stop], np.cumsum(new[at:stop])
            which = np.repeat(np.arange(len(part)), part["count"])
            shift = np.arange(len(which)) - np.repeat(np.cumsum(part["count"].astype(np.int64)) - part["count"], part["count"])
            text = part["bytes"][which[:, None], shift[:, None] + np.arange(length)]
            gone = equal_windows(text, group[which], part["doc"][which], length)
            which, shift = which[gone], shift[gone]
            if len(which):
                run = np.r_[True, (which[1:] != which[:-1]) | (shift[1:] != shift[:-1] + 1)]
                begin = np.flatnonzero(run)
                close = np.r_[begin[1:], len(which)] - 1
                start = part["first"][which[begin]]
                out.append(_spans(part["doc"][which[begin]], start + shift[begin], start + shift[close] + length))
            at = stop
        if out:
            spans = np.concatenate(out)
            yield _blobs([(p, b, None) for p, b in _dealt(spans["doc"], spans, parts)], "ibb", ["part", "spans", "asked"])

    asked = settled_rows.where("asked IS NOT NULL").select("node", "asked")
    contexts = docs.join(asked, docs["doc_id"] == asked["node"]).select("text", "node", "asked").where("text IS NOT NULL").mapInArrow(asked_for, "part int, contexts binary")
    second = contexts.repartition(parts // 4, "part").mapInArrow(sorted_out, "part int, spans binary, asked binary")
    more = _gathered(written(second, "sorted-windows"), parts, "window-spans")
    return settled_rows.where("spans IS NOT NULL").select("node", "spans").union(more.where("spans IS NOT NULL").select("node", "spans"))


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the spans, the number of bytes removed and of maximal runs."""
    if not spans:
        return raw, 0, 0
    left, end, runs, removed = [], 0, 0, 0
    for start, stop in sorted(spans):
        if start > end or not runs:
            left.append(raw[end:start])
            runs += 1
            removed += stop - start
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    left.append(raw[end:])
    return b"".join(left), removed, runs


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` for each row: what stays of the text's UTF-8 bytes.

    A byte goes if a ``length``-byte string that covers it also starts in a document of a smaller id; strings are judged
    on the input and never cross documents. A null text is empty; texts under ``length`` bytes stay. Rows with a null id
    stay as they are and count for no other. Rows that repeat an id don't remove each other's bytes; of rows with one id
    and different texts, spans found in either are applied where both have the bytes, so ids should be unique. Copies
    are met by hashes of 64 bits for an anchor and as many for its stretch, everything else by its bytes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(docs, length=length, **options)
    gathered = spans.groupBy("node").agg(F.collect_list("spans").alias("spans"))
    pair = np.dtype([("start", "<i8"), ("end", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text, data in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    cuts = [(s, min(e, len(raw))) for d in data or [] for s, e in unpacked(d, pair).tolist() if s < len(raw)]
                    kept, removed, runs = kept_text(raw, cuts)
                    rows.append((doc, len(raw), removed, runs, kept))
                yield _blobs(rows, "llllb", names)

    return docs.join(gathered, docs["doc_id"] == gathered["node"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """The digest columns by a dictionary of all windows, for tests."""
    raws = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
    smallest: dict[bytes, int] = {}
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                smallest[w] = min(smallest.get(w, d), d)
    out = []
    for d, raw in raws:
        spans = [(i, i + length) for i in range(len(raw) - length + 1) if d is not None and smallest[raw[i : i + length]] < d]
        kept, removed, runs = kept_text(raw, spans)
        out.append((d, len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
    return out
