"""Media columns: texts as PNG images in binary columns, read back through checked chunks, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types of PNG. Fixed values.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(kind: int, left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    if kind == AVERAGE:
        return (left + above) >> 1
    to_left, to_above, to_corner = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
    return np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))


def _filtered(rows: np.ndarray, channels: int, most: int) -> np.ndarray:
    """The samples less what each filter up to ``most`` predicts: filters x rows x samples."""
    height, width = rows.shape
    wide = np.zeros((height + 1, width + channels), np.int16)
    wide[1:, channels:] = rows
    here, left, above, corner = wide[1:, channels:], wide[1:, :-channels], wide[:-1, channels:], wide[:-1, :-channels]
    guesses = [np.zeros_like(here), left, above, *(_predicted(k, left, above, corner) for k in range(AVERAGE, most + 1))]
    return np.stack([(here - g).astype(np.uint8) for g in guesses[: most + 1]])


def chosen_filters(residues: np.ndarray) -> np.ndarray:
    """The filter of each row whose residues, taken as signed, have the smallest sum of magnitudes; ties go to the lower.

    ``residues`` has the filters that may be chosen. The first three are undone a whole run of rows at a time.
    """
    return np.abs(residues.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0).astype(np.uint8)


def encode_png(pixels: np.ndarray, filters=None, level: int = 6) -> bytes:
    """PNG of ``height x width x channels`` 8-bit samples; ``filters``: one filter for all rows, one for each, or None
    to choose NONE, SUB or UP for each row."""
    height, width, channels = pixels.shape
    colour = next(k for k, n in CHANNELS.items() if n == channels)
    given = None if filters is None else np.broadcast_to(np.asarray(filters, np.uint8), (height,))
    residues = _filtered(pixels.reshape(height, width * channels), channels, UP if given is None else int(given.max(initial=0)))
    kinds = chosen_filters(residues) if given is None else given
    lines = np.empty((height, width * channels + 1), np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = residues[kinds, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; raises ``ValueError`` on a wrong signature, length or checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a PNG chunk is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise ValueError("a PNG chunk is cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("a PNG without an end")


def decode_png(data: bytes) -> np.ndarray:
    """``height x width x channels`` samples of an 8-bit PNG that is not interlaced or palette-based."""
    head, packed = None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif not kind[0] & 32 and kind != b"IEND":
            raise ValueError(f"unsupported chunk {kind!r}")
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise ValueError("unsupported PNG layout")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * channels + 1)
    kinds, rows = lines[:, 0], lines[:, 1:]
    return unfiltered(kinds, rows.reshape(height, width, channels))


def unfiltered(kinds: np.ndarray, residues: np.ndarray) -> np.ndarray:
    """The samples behind filtered rows (``height x width x channels``).

    Rows that need no neighbour, the one to the left alone or the one above alone are undone a run of rows at a time. In
    a run of the two filters that need both, a pixel needs only pixels of earlier diagonals, so each diagonal is one step.
    """
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown row filter")
    height, width, channels = residues.shape
    out = np.zeros((height + 1, width + 1, channels), np.uint8)  # with a row above and a pixel to the left
    classes = np.where(kinds >= AVERAGE, AVERAGE, kinds)
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if height else []
    for start, stop in zip(starts, [*starts[1:], height], strict=True):
        part, into = residues[start:stop], out[start + 1 : stop + 1, 1:]
        if classes[start] == NONE:
            into[:] = part
        elif classes[start] == SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=into)
        elif classes[start] == UP:
            np.cumsum(part, axis=0, dtype=np.uint8, out=into)
            into += out[start, 1:]
        else:
            _undo_diagonals(kinds[start:stop], part, out[start : stop + 1])
    return out[1:, 1:]


def _undo_diagonals(kinds: np.ndarray, residues: np.ndarray, out: np.ndarray) -> None:
    """Undo AVERAGE and PAETH rows into ``out``, whose first row and column are known."""
    height, width, _ = residues.shape
    paeth = (kinds == PAETH)[:, None]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = (out[y + dy, x + dx].astype(np.int16) for dy, dx in ((1, 0), (0, 1), (0, 0)))
        guess = np.where(paeth[y], _predicted(PAETH, left, above, corner), _predicted(AVERAGE, left, above, corner))
        out[y + 1, x + 1] = (residues[y, x] + guess).astype(np.uint8)


def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(keep), 2 * np.arange(n) + 1) / (2 * n))


def perceptual_hash(pixels: np.ndarray, side: int = 32, keep: int = 8) -> bytes:
    """64-bit hash: signs against their median of the ``keep x keep`` lowest cosine frequencies of the grey image,
    averaged over ``side x side`` cells. Whole images count; the constant term takes part as zero."""
    grey = pixels.mean(axis=2)
    height, width = grey.shape
    def cells(n: int) -> np.ndarray:
        return np.arange(side) * n // side

    tall = np.add.reduceat(np.repeat(grey, max(1, -(-side // height)), axis=0), cells(height * max(1, -(-side // height))), axis=0)
    small = np.add.reduceat(np.repeat(tall, max(1, -(-side // width)), axis=1), cells(width * max(1, -(-side // width))), axis=1)
    small /= np.add.reduceat(np.ones(height * max(1, -(-side // height))), cells(height * max(1, -(-side // height))))[:, None]
    small /= np.add.reduceat(np.ones(width * max(1, -(-side // width))), cells(width * max(1, -(-side // width))))[None, :]
    low = _cosines(side, keep) @ small @ _cosines(side, keep).T
    low[0, 0] = 0
    return np.packbits(low.reshape(-1) > np.median(low)).tobytes()


def text_payload(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """UTF-8 of a text, padded with spaces to a positive multiple, and its length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (multiple - len(raw) if not raw else -len(raw) % multiple), len(raw)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, filters=None) -> DataFrame:
    """``doc_id, n_bytes, media binary``: each text's padded bytes as an RGB PNG ``width`` pixels wide.

    A null text counts as empty and is stored as one row of spaces. Null ids stay null, repeated rows are stored each,
    other columns are left out. Each pixel row takes the filter that leaves the least. Narrow; memory follows the
    longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, media = [], []
                for text in part.column(1):
                    payload, size = text_payload(text.as_py(), 3 * width)
                    sizes.append(size)
                    media.append(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, width, 3), filters))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds ``payload binary`` (the samples read back) and ``phash binary`` to the rows of :func:`store_media`.

    Null media give a null payload and hash; damaged media raise. Null ids, repeats and empty tables are passed on.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads, hashes = [], []
                for data in part.column(2):
                    if not data.is_valid:
                        payloads.append(None)
                        hashes.append(None)
                        continue
                    pixels = decode_png(data.as_py())
                    payloads.append(pixels.tobytes())
                    hashes.append(perceptual_hash(pixels))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "n_bytes", "media", "payload", "phash"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, phash binary")


def digests(read: DataFrame) -> DataFrame:
    """Lengths, digests and feature of the rows of :func:`read_media`."""
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )


def digest_of(text: str | None, width: int = 64) -> tuple:
    """The digest columns of one text, for tests: computed with hashlib and zlib alone, but for the media bytes."""
    payload, size = text_payload(text, 3 * width)
    return size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
