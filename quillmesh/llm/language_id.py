"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and a calibrated rejection.

Subwords are runs of one to ``longest`` characters of a word in lower case, its borders being characters of their own. A
text's vector is the mean of its subwords' embeddings; embeddings and softmax are trained together by stochastic
gradient descent. Both steps of the score are linear, so a trained model is one row of logits for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.memory import released

_PIECE = 1 << 18  # characters of a text that are hashed at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None, buckets: int, longest: int) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, repeats included, a piece of the text at a time; ``buckets`` is a power of two.

    Anything but a letter is a border, and so are the text's ends. A subword has a letter, and borders at its ends alone.
    """
    low = (text or "").lower()
    for start in range(0, len(low) + 2, _PIECE):  # places of the text with a border before and after it
        stop = start + _PIECE + longest - 1
        codes = np.frombuffer(low[max(start - 1, 0) : stop - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[0] * (start == 0), np.where(_letters()[codes], codes, 0), [0] * (stop > len(low) + 1)]).astype(np.uint64)
        letter = codes > 0
        mixed, inner = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
        for n in range(1, min(longest, len(codes)) + 1):
            m = len(codes) - n + 1
            mixed = mixed[:m] * np.uint64(0x9E3779B97F4A7C15) ^ (codes[n - 1 :] + np.uint64(n))
            if n > 2:
                inner = inner[:m] & letter[n - 2 : n - 2 + m]
            valid = letter if n == 1 else letter[:-1] | letter[1:] if n == 2 else inner
            found = mixed[np.flatnonzero(valid[:_PIECE])] * np.uint64(0xFF51AFD7ED558CCD)
            yield (found >> np.uint64(33)).astype(np.int64) & (buckets - 1)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts_of(text: str | None, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's subwords, and the share of its subwords that each has."""
    total = np.zeros(buckets, np.int64)
    for some in subwords(text, buckets, longest):
        total += np.bincount(some, minlength=buckets)
    columns = np.flatnonzero(total)
    return columns.astype(np.int32), (total[columns] / max(total.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """``logits[bucket, language]`` with the embeddings multiplied out, biases, temperature and the score from which a
    prediction is accepted."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    longest: int
    temperature: float = 1.0
    accept: float = 0.0

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        x = raw / self.temperature
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ``und`` and 0 for a text without a letter or a model without a language."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(self.languages)), 0
        for some in subwords(text, len(self.logits), self.longest):
            total += self.logits[some].sum(axis=0, dtype=np.float64)
            n += len(some)
        p = self.probabilities(total / max(n, 1) + self.bias)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], *, buckets: int, longest: int, size: int = 16, epochs: int = 8, batch: int = 32, rate: float = 1.0, spread: float = 50.0, seed: int = 1, hold: int = 5, lost: float = 0.01) -> Model:
    """A model of (language, buckets, shares) samples; the order of samples decides, so give them a fixed one.

    Embeddings take ``spread`` times the softmax's steps, as each has but a small share of a text's mean.

    Every ``hold``-th sample is kept out of the descent: the temperature is the one under which these are likeliest, and
    ``accept`` is the score that a share ``lost`` of those predicted rightly doesn't reach.
    """
    languages = sorted({s[0] for s in samples})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), longest)
    index = {name: k for k, name in enumerate(languages)}
    apart = [s for i, s in enumerate(samples) if i % hold == hold - 1]
    own = [s for i, s in enumerate(samples) if i % hold != hold - 1]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (buckets, size)).astype(np.float32)
    softmax = np.zeros((size, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(own))
        for start in range(0, len(own), batch):
            some = [own[i] for i in order[start : start + batch]]
            x = np.zeros((len(some), buckets), np.float32)
            for row, (_, columns, shares) in zip(x, some, strict=True):
                row[columns] = shares
            mean = x @ embed
            raw = mean @ softmax + bias
            error = np.exp(raw - raw.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(some)), [index[s[0]] for s in some]] -= 1
            error /= len(some)
            back = error @ softmax.T
            softmax -= step * (mean.T @ error)
            bias -= 0.1 * step * error.sum(axis=0)
            embed -= spread * step * (x.T @ back)
    model = Model(languages, (embed @ softmax).astype(np.float32), bias.astype(np.float64), longest)
    if apart:
        raw = np.stack([s[2].astype(np.float64) @ model.logits[s[1]].astype(np.float64) for s in apart]) + model.bias
        truth = np.array([index[s[0]] for s in apart])

        def loss(t: float) -> float:
            model.temperature = t
            return -float(np.log(np.maximum(model.probabilities(raw)[np.arange(len(truth)), truth], 1e-12)).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
        p = model.probabilities(raw)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.accept = float(np.quantile(right, lost)) if len(right) else 1.0
    return model


def held_out(id_col: Column) -> Column:
    """Whether the checksum of an id falls into the third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4_000, max_languages: int = 256, buckets: int = 1 << 14, longest: int = 4, **options) -> Model:
    """A model learned from at most ``max_rows`` labelled rows that aren't held out, dealt evenly to the languages.

    The ``max_languages`` most frequent languages are learned. Of each, rows whose id's digest is below a bound that
    leaves about its part are taken, whole texts; of those the smallest digests, if chance leaves too many. Rows with a
    null id, language or text, and texts without a letter, teach nothing. Shares of at most ``buckets`` subwords of each
    row come to the driver.
    """
    able = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    able = able.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not sizes:
        return train([], buckets=buckets, longest=longest, **options)
    part = max_rows / len(sizes)
    bound = docs.sparkSession.createDataFrame([(name, min(1.0, part / n)) for name, n in sizes.items()], "lang string, bound double")
    digest = F.md5(F.col("id").cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    picked = able.join(F.broadcast(bound), "lang").where(u < F.col("bound")).select("lang", digest.alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t.as_py(), buckets, longest) for t in batch.column(2)]
            columns = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["lang", "digest", "buckets", "shares"])

    rows = picked.mapInArrow(run, "lang string, digest string, buckets array<int>, shares array<float>").where(F.size("buckets") > 0)
    rows = rows.orderBy("digest", "lang", F.xxhash64("buckets")).limit(max_rows).toArrow()
    samples = [(r[0].as_py(), np.asarray(r[1].values), np.asarray(r[2].values)) for r in zip(rows.column("lang"), rows.column("buckets"), rows.column("shares"), strict=True)]
    return train(samples, buckets=buckets, longest=longest, **options)


def identified(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for each row; the whole text alone makes the prediction.

    Null texts, texts without a letter and all texts under a model without languages are ``und`` with score 0. ``score``
    is the calibrated probability; ``accepted`` is false under the model's bound, for whoever would rather have no
    answer. A null id isn't held out; repeated rows are predicted each; other columns are left out. The model, bounded
    by its buckets and languages, is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            accepted = [s >= shared.value.accept and n != "und" for n, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])
        released()

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
