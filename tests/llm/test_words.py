"""Spelling variants, importance resampling and language identification against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import importance_resampling, language_id, spelling_groups
from quillmesh.llm.queries import table
from tests.llm.test_sql import SMALLEST

SCHEMA = "doc_id long, text string, lang string, word string, n long, row_ long, rank long, key string, score double"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, (langs or {}).get(k, "en"), "w", 1, 2, 3, "k", 0.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


# ---- operator 11


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [x for x in n if distance_is_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variants(rng):
    stems = ["abcdefg", "interest", "aaaaaa", "éàüßÿ", "ababab", "übermäßig", "abcdefgh" * 3, "x×÷yzw"]
    words = []
    for stem in stems:
        own = {stem}
        for _ in range(60):
            w = list(rng.choice(sorted(own)))
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                del w[at]
            else:
                w[at : at + (kind == 1)] = rng.choice("abcdefghé")
            own.add("".join(w))
        words += own
    return words


def test_spelling_variants_by_brute_force(spark):
    rng = random.Random(5)
    words = variants(rng)
    texts = [None, "", " \n", "Ābc ÀÉ 12", "A" * 4000 + " " + "a" * 4000, "a" * 4000]
    texts += [" ".join((w.upper() if rng.random() < 0.1 else w) + rng.choice(["", ".", "1", "_"]) for w in rng.choices(words, k=150)) for _ in range(60)]
    texts += texts[-3:]
    ids = [None, *range(len(texts) - 2), 7]
    out = spelling_groups.grouped(frame(spark, texts, ids)).collect()
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out]
    want = plain_groups(zip(ids, texts, strict=True))
    assert len(want) > 300 and any(t[1] and t[1] != t[2] for t in want)
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("hot, shard_rows", [(1, 40), (8, 1_000_000), (1_000_000, 1_000_000)])
def test_near_words_when_halves_are_crowded(spark, hot, shard_rows):
    words = sorted(set(variants(random.Random(6))) - {""})
    words = [w for w in words if len(w) >= 2]
    rows = spark.createDataFrame([(w, 3 + k % 5) for k, w in enumerate(words)], "word string, n long")
    n = {w: 3 + k % 5 for k, w in enumerate(words)}
    got = {r["word"]: (r["n_near"], -r["best"]["minus_n"], r["best"]["word"]) for r in spelling_groups.near_words(rows, hot=hot, shard_rows=shard_rows).collect()}
    want = {}
    for w in words:
        if near := [x for x in words if distance_is_one(w, x)]:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_spelling_variants_of_no_rows_and_bad_parameters(spark):
    assert spelling_groups.grouped(frame(spark, [])).count() == 0
    for options in ({"factor": 1}, {"least_chars": 1}):
        with pytest.raises(ValueError):
            spelling_groups.grouped(frame(spark, ["a"]), **options)


def test_runs_of_pieces_are_whole():
    text = "Abc déf" * 50 + "x" * 90 + " 1é2"
    for piece in (1, 3, 64, 10_000):
        assert list(itertools.chain(*spelling_groups.runs_of(text, piece))) == re.findall("[a-zÀ-ÿ]+", text.translate(_LOW))


# ---- operator 12


def plain_resampled(docs, target, n_buckets=10_000, least=20, percent=5):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    rows = []
    for i, text in docs:
        n_words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[-1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = rank + 1
    return collections.Counter(map(tuple, rows))


def resampling_texts():
    rng = random.Random(8)
    words = [rng.choice("aAbÉ0é漢") * rng.randrange(1, 4) + rng.choice(["", "x", "😀"]) for _ in range(40)] + ["w" * 300]
    sentence = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "."]) for _ in range(n))
    texts = [None, "", "... ", "one", "a b", sentence(700)] + [sentence(rng.randrange(1, 120)) for _ in range(150)]
    return texts + texts[-5:], [None, "", sentence(60), sentence(30)]


def test_resampling_by_brute_force(spark):
    texts, target = resampling_texts()
    ids = [*range(len(texts) - 6), None, *range(len(texts) - 11, len(texts) - 6)]  # rows that repeat, ids included
    out = importance_resampling.resampled(frame(spark, texts, ids), frame(spark, target)).collect()
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")) for r in out)
    assert got == plain_resampled(list(zip(ids, texts, strict=True)), target)
    assert sum(r["rank"] is not None for r in out) >= 5


def test_features_do_not_depend_on_blocks(monkeypatch):
    texts, _ = resampling_texts()

    def found(block):
        monkeypatch.setattr(importance_resampling, "BLOCK", block)
        out = collections.Counter()
        for k, (rows, buckets) in enumerate(importance_resampling._blocks(pa.array(texts), 977)):
            out.update(zip(itertools.repeat(k % 3), rows.tolist(), buckets.tolist()))
        return out

    assert found(50) == found(3) == found(1 << 18)


def test_resampling_without_rows_or_target(spark):
    docs = frame(spark, ["a " * 30] * 40)
    assert importance_resampling.resampled(frame(spark, []), docs).count() == 0
    rows = importance_resampling.resampled(docs, frame(spark, [])).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2] and len({r["weight"] for r in rows}) == 1


def test_checksums_of_joined_words():
    words = [b"a", b"bc", "é".encode(), b"x" * 5000]
    hashes = importance_resampling._Hashes(words)
    for a, b, c in itertools.product(range(4), repeat=3):
        two = hashes.longer(hashes.first[[a]], np.array([b]))
        assert int(hashes.longer(two, np.array([c]))[0]) == zlib.crc32(b" ".join((words[a], words[b], words[c])))


# ---- operator 13


def plain_subwords(text, longest):
    s = ["", *(c if c.isalpha() else "" for c in (text or "").lower()), ""]
    return collections.Counter(tuple(s[i : i + n]) for n in range(1, longest + 1) for i in range(len(s) - n + 1) if all(s[i + 1 : i + n - 1]) and any(s[i : i + n]))


def test_subwords_by_brute_force(monkeypatch):
    texts = [None, "", " ", "x", "Hello wörld!! a b  c", "ab1cd\n" * 9, "漢字かな ÀÉ 😀a", "İi"]
    for piece in (1 << 18, 3, 7):
        monkeypatch.setattr(language_id, "_PIECE", piece)
        for text in texts:
            got = collections.Counter(np.concatenate([*language_id.subwords(text, 1 << 30, 4), np.zeros(0, np.int64)]).tolist())
            assert sorted(got.values()) == sorted(plain_subwords(text, 4).values())


def test_language_of_held_out_documents(spark):
    docs = table(spark, SMALLEST.replace("sf0.001", "sf0.01"), "documents")
    rows = language_id.identified(docs, language_id.fit(docs)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held]
    assert len(held) > 200 and np.mean(right) > 0.98
    kept = [ok for ok, r in zip(right, held, strict=True) if r["accepted"]]
    assert len(kept) > 0.9 * len(held) and np.mean(kept) >= np.mean(right)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_labels_of_held_out_rows_are_not_read(spark):
    texts = ["der die das und"] * 40 + ["the of and to"] * 40 + [None, "", "123 --", "und der"]
    langs = {k: "de" if k < 40 else "en" if k < 80 else None for k in range(84)}
    other = {k: "xx" if zlib.crc32(str(k).encode()) % 3 == 1 else v for k, v in langs.items()}
    rows = [language_id.identified(d, language_id.fit(d)).orderBy("doc_id").collect() for d in (frame(spark, texts, langs=x) for x in (langs, other))]
    assert rows[0] == rows[1]
    assert [r["lang_pred"] for r in rows[0]] == ["de"] * 40 + ["en"] * 40 + ["und"] * 3 + ["de"]
    assert all(r["score"] == 0 and not r["accepted"] for r in rows[0][80:83])


def test_language_model_of_nothing_or_one_language(spark):
    none = language_id.fit(frame(spark, []))
    assert [tuple(r)[1:] for r in language_id.identified(frame(spark, ["abc"], [None]), none).collect()] == [(False, "und", 0.0, False)]
    one = frame(spark, ["abc def"] * 9)
    assert {r["lang_pred"] for r in language_id.identified(one, language_id.fit(one)).collect()} == {"en"}
