"""Toxicity: a logistic classifier whose scores may not depend on which group a sentence names.

It is trained on words that are present in labelled documents. For each training text with identity terms a
counterfactual is made by swapping every term for its partner, and the squared change of the score's logit is penalised
along with the usual loss, so a neutral mention of a group gains nothing from the groups that toxic texts name more often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neutral identity terms, each with the term that takes its place.
IDENTITY_PAIRS = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("muslims", "christians"), ("muslim", "christian"),
    ("jews", "hindus"), ("jewish", "hindu"), ("blacks", "whites"), ("black", "white"), ("asian", "european"), ("african", "american"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("immigrants", "citizens"), ("immigrant", "citizen"),
    ("disabled", "abled"), ("old", "young"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens"), ("musulman", "chrétien"),
    ("juifs", "hindous"), ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen"), ("juden", "hindus"), ("mujeres", "hombres"),
    ("mujer", "hombre"), ("musulmanes", "cristianos"), ("judíos", "hindúes"),
]
SWAP = {a: b for pair in IDENTITY_PAIRS for a, b in (pair, pair[::-1])}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text in lower case."""
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and beginnings of four to six letters marked with a dash: inflected forms share them."""
    return words.union(*({w[:n] + "-" for w in words if len(w) >= n} for n in (4, 5, 6)))


def counterfactual(words: set[str]) -> set[str] | None:
    """The words after every identity term is swapped, or None if there is none."""
    if words.isdisjoint(SWAP):
        return None
    return {SWAP.get(w, w) for w in words}


class _Rows:
    """Word indices of texts as flat arrays, for products with a weight vector."""

    def __init__(self, texts: list[set[str]], index: dict[str, int]):
        picked = [[index[w] for w in words if w in index] for words in texts]
        self.n, self.width = len(texts), len(index)
        self.row = np.repeat(np.arange(self.n), [len(p) for p in picked])
        self.col = np.array([i for p in picked for i in sorted(p)], np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, values[self.row], self.width)


def train(texts: list[set[str]], labels: np.ndarray, *, counterfactual_weight: float = 5.0, ridge: float = 2e-5, z: float = 4.0, least: int = 4, steps: int = 400, rate: float = 0.2) -> dict[str, float]:
    """Weights by feature, the bias under the empty one.

    Features take part if their share among toxic and other texts differs by ``z`` standard errors and ``least`` texts have
    them, and identity terms always. Without labels of both kinds the bias alone is learned.
    """
    y = np.asarray(labels, float)
    n, toxic = len(y), int(y.sum())
    if not 0 < toxic < n:
        return {"": -4.0 if not toxic else 4.0}
    counts: dict[str, list[int]] = {}
    swapped = [(i, features_of(c)) for i, c in enumerate(map(counterfactual, texts)) if c is not None]
    texts = [features_of(words) for words in texts]
    for words, label in zip(texts, y, strict=True):
        for w in words:
            counts.setdefault(w, [0, 0])[int(label)] += 1
    index: dict[str, int] = {}
    for w in sorted(counts):
        clean, bad = counts[w]
        p = (clean + bad) / n
        error = np.sqrt(max(p * (1 - p), 1e-12) * (1 / toxic + 1 / (n - toxic)))
        if w in SWAP or clean + bad >= least and abs(bad / toxic - clean / (n - toxic)) > z * error:
            index[w] = len(index)
    for w in sorted(SWAP):
        index.setdefault(w, len(index))
    own, other = _Rows([texts[i] for i, _ in swapped], index), _Rows([c for _, c in swapped], index)
    rows = _Rows(texts, index)
    weights, bias = np.zeros(len(index)), float(np.log(toxic / (n - toxic)))
    first, second = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, steps + 1):  # Adam over the whole sample: the result doesn't depend on any order
        error = (1 / (1 + np.exp(-np.clip(rows.times(weights) + bias, -30, 30))) - y) / n
        slope = rows.back(error) + ridge * weights
        if swapped:
            change = own.times(weights) - other.times(weights)
            slope += counterfactual_weight * 2 / n * (own.back(change) - other.back(change))
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {"": float(bias)} | {w: float(weights[i]) for w, i in index.items()}


def score_words(words: set[str], weights: dict[str, float]) -> float:
    total = weights[""] + sum(weights[w] for w in sorted(features_of(words) & weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def held_out(id_col: Column) -> Column:
    """Whether the checksum of an id falls into the third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8_000, **options) -> dict[str, float]:
    """Weights learned from at most ``max_rows`` labelled rows that aren't held out: those of the smallest id digests.

    Rows with a null id or label are passed over; of several labels of one id the largest counts. The bounded id table
    is broadcast, and the distinct words of the sampled texts come to the driver.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("label_id_"))
        .agg(F.max("toxic").alias("toxic_"))
        .orderBy(F.md5(F.col("label_id_").cast("string").cast("binary")), "label_id_")
        .limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ["\n".join(sorted(words_of(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], ["doc_id", "toxic", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id_")).select("doc_id", F.col("toxic_").cast("int").alias("toxic"), "text")
    rows = sample.mapInArrow(run, f"doc_id {kind}, toxic int, words string").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    known: dict[str, str] = {}
    sets = [{known.setdefault(w, w) for w in t.as_py().split("\n") if w} for t in rows.column("words")]
    return train(sets, np.array(rows.column("toxic").to_pylist(), float), **options)


def scored(docs: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; the text alone makes the score.

    A null or empty text gets the bias's score. A null id isn't held out. Repeated rows are scored each, other columns
    are left out. The weights (bounded by the sample's words) are broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_words(words_of(t.as_py()), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
