"""SentencePiece BPE encoding and decoding with a prefix table instead of a merge loop.

For every prefix of a chunk the last token of its encoding is unique. An Aho-Corasick automaton lists the pieces that
end at a position; the one that is compatible with the last token of the prefix before it is stored. Walking the table
backwards from the end recovers the ids. Two tokens are compatible when merging their joined text gives them back.

No piece holds a word mark after another character, so a text is cut before each run of word marks and chunks are
encoded on their own. A memo bounded in bytes keeps the ids of chunks that came lately. Each chunk is decoded from its
ids when it is first encoded; where that gives the chunk itself, a text of such chunks decodes to itself, and only the
ids are kept.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.memory import released

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NEVER = float("inf")
_ENTRY, _PAIR = 150, 100  # bytes that an entry of a memo takes beside its text and ids, and one of the pair table
_LETTER, _SIGN = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[\n\t!-/:-@\[-`{-~]"
_TURN = f"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}"
_WORD_END, _ENDS = re.compile(_LETTER), frozenset(",.;:!?")
_PARTS = f"(?<={_LETTER})(?={_SIGN})|(?<={_SIGN})(?={_LETTER})"


class _Recent:
    """Packed ids by text in two generations of half of ``most`` bytes: when the newer is full, the older one goes."""

    def __init__(self, most: int):
        self.most = most // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, text: str) -> bytes | None:
        found = self.new.get(text)
        if found is None and (found := self.old.get(text)) is not None:
            self.put(text, found)
        return found

    def put(self, text: str, ids: bytes) -> None:
        self.held += _ENTRY + len(text) + len(ids)
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[text] = ids


class PrefixTableBpe:
    """Encoder and decoder over one serialized model. ``memo_limit`` bounds the memos and the pair table together, in bytes."""

    def __init__(self, model: bytes, memo_limit: int = 96 << 20):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.id_of, self.cost = {}, {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[p] = i
                self.cost[p] = -sp.get_score(i)
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of):
            raise ValueError("a piece holds a word mark after another character")
        if sp.normalize("ﬁ  x\t") not in (f"{MARK}ﬁ{MARK}{MARK}x\t",):
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        #: Where no piece goes from a letter to an ASCII sign or back, words and the signs around them are independent.
        self.parts = None if any(re.search(_TURN, p.lstrip(MARK)) for p in self.id_of) else re.compile(_PARTS)
        self.special = {*self.bytes_of, *self.silent, self.unk}
        self.memo = _Recent(memo_limit * 5 // 8)
        self.later = _Recent(memo_limit // 4)
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]
        self.n_pairs, self.most_pairs = 0, memo_limit // 8 // _PAIR
        #: Whether a chunk was met that doesn't decode to itself; texts are then decoded from all their ids.
        self.odd = False

    def merged(self, text: str) -> list[str]:
        """The pieces that plain merging gives: best score first, leftmost among equals."""
        parts = list(text)
        cost = self.cost.get
        joins = [cost(x + y, _NEVER) for x, y in zip(parts, parts[1:])]
        while joins and (best := min(joins)) < _NEVER:
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = cost(parts[i - 1] + parts[i], _NEVER)
            if i < len(joins):
                joins[i] = cost(parts[i] + parts[i + 1], _NEVER)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their texts are joined; ``left`` -1 stands for nothing."""
        row = self.pairs[left]
        known = row.get(right)
        if known is None:
            if self.n_pairs >= self.most_pairs:
                for other in self.pairs:
                    other.clear()
                self.n_pairs = 0
            both = [self.pieces[i] for i in (left, right) if i >= 0]
            known = row[right] = self.merged("".join(both)) == both
            self.n_pairs += 1
        return known

    def chunk_ids(self, text: str) -> list[int]:
        """Ids of one chunk, by the prefix table."""
        if (known := self.id_of.get(text)) is not None and self.compatible(-1, known):
            return [known]
        n = len(text)
        last = [-1] * (n + 1)
        size = [1] * (n + 1)
        pairs = self.pairs
        for at, (token, length) in self.automaton.iter(text):  # at one end, longer pieces come first
            at += 1
            if last[at] < 0:
                left = last[at - length]
                fits = pairs[left].get(token)
                if fits or fits is None and self.compatible(left, token):
                    last[at], size[at] = token, length
        out: list[int] = []
        end = n
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
            else:  # a character outside the vocabulary falls back to its bytes
                raw = text[end - 1].encode("utf-8", "surrogatepass")
                out.extend(self.byte_id.get(b, self.unk) for b in reversed(raw))
            end -= size[end]
        out.reverse()
        return out

    def decode(self, ids) -> str:
        """Text of ids: byte runs become characters, marks become spaces, the dummy prefix goes."""
        text = self._joined(ids)
        return text[1:] if text.startswith(" ") else text

    def _joined(self, ids) -> str:
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def _new(self, memo: _Recent, text: str, mark: str) -> bytes:
        ids = self.chunk_ids(mark + text)
        found = array("i", ids).tobytes()
        self.odd = self.odd or self._joined(ids) != (mark + text).replace(MARK, " ")
        if len(text) <= 64:
            memo.put(text, found)
        return found

    def _looked_up(self, chunk: str) -> bytes:
        """Packed ids of a chunk without its first mark; independent parts are looked up singly."""
        if (known := self.memo.get(chunk)) is not None:
            return known
        if self.parts and chunk[-1:] in _ENDS and _WORD_END.match(chunk, len(chunk) - 2):
            word = chunk[:-1]  # the commonest of such chunks take no place of their own
            return (self.memo.get(word) or self._looked_up(word)) + (self.later.get(chunk[-1]) or self._new(self.later, chunk[-1], ""))
        parts = self.parts.split(chunk) if self.parts and MARK not in chunk else [chunk]
        if len(parts) < 2:
            return self._new(self.memo, chunk, MARK)
        found = [self.memo.get(parts[0]) or self._new(self.memo, parts[0], MARK)]
        found += [self.later.get(p) or self._new(self.later, p, "") for p in parts[1:]]
        whole = b"".join(found)
        if len(chunk) <= 32:
            self.memo.put(chunk, whole)
        return whole

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Packed int32 ids with the end id, and what they decode to."""
        if not text:
            return struct.pack("i", self.eos), ""
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            chunks = text.split(" ")
        known, new = self.memo.new.get, self._looked_up
        ids = b"".join([known(c) or new(c) for c in chunks])
        decoded = self.decode(array("i", ids)) if self.odd else text.replace(MARK, " ")
        return ids + struct.pack("i", self.eos), decoded


_loaded: dict[tuple[bytes, int], PrefixTableBpe] = {}


def _worker_bpe(model: bytes, memo_limit: int) -> PrefixTableBpe:
    """The encoder of this Python worker, kept between tasks with its memo."""
    if (model, memo_limit) not in _loaded:
        _loaded.clear()
        _loaded[model, memo_limit] = PrefixTableBpe(model, memo_limit)
    return _loaded[model, memo_limit]


def encode_decode(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", memo_limit: int = 96 << 20) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for each row; other columns are left out.

    A null or empty text has the end id alone and decodes to the empty text. A null id stays null, repeated rows are
    encoded each on their own, an empty table gives an empty table. ``model`` (the serialized model, under 1 MB) is
    broadcast; nothing is shuffled. Long texts take memory in proportion to their own length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(shared.value, memo_limit)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed, decoded, ends = [], [], array("i", [0])
                for text in part.column(1).to_pylist():
                    ids, back = bpe.encode(text)
                    packed.append(ids)
                    decoded.append(back)
                    ends.append(ends[-1] + len(ids) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        released()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode_decode`'s rows, on the JVM side."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
