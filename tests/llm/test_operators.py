"""Operators against plain versions on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import components, licence_scan, line_dedup, ngram_join, png_media, quality_rules, sentencepiece_bpe, source_mix, suffix_dedup, toxicity, warc_archive
from quillmesh.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_lines long, h1 long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [sentence(rng, 120) for _ in range(6)]
    shared = "\n".join(sentence(rng, 12) for _ in range(9))
    texts = [None, "", " ", "\n\n", "one", "ONE", "a b c", "é" * 3000, "  two  spaces  ", "▁mark▁ x", "A" * 70]
    texts += base + base[:3] + [b.replace("alpha", "ALPHA") for b in base[:2]]
    for b in base:
        w = b.split(" ")
        for edits in (1, 2, 4, 9):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
    texts += [f"{sentence(rng, 20)}\n{shared}\n{sentence(rng, 15)}" for _ in range(4)] + [shared, shared]
    texts += ["Released under the MIT License.\n" + sentence(rng, 60), "cc by nc", "the apache license version 2 and under the mit license"]
    rows = [(i, t, "en", ("b", None, "a", "")[i % 4], len(t or ""), 7, 8, 9) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, base[0], "en", "a", 5, 1, 1, 1), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) if not isinstance(x, (list, dict)) else (True, str(x)) for x in r])


def test_sentencepiece_is_the_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in corpus():
        ids = sp.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    run = lambda d: sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(d, piece_model())).collect()
    assert plain(run(docs)) == plain(want)
    assert run(none) == []


def test_prefix_table_fuzz():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    bpe = sentencepiece_bpe.PrefixTableBpe(piece_model(), memo_limit=50)
    rng = random.Random(5)
    parts = ["a", "b", "th", "ing", " ", "  ", "\n", "é", "ü", "▁", "　", "😀", "\t", "==", "--", "0", "//", "中", "\x00", ".", ","]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        packed, back = bpe.encode(text)
        ids = np.frombuffer(packed, np.int32).tolist()
        assert ids == sp.encode(text, add_eos=True) and back == sp.decode(ids) == bpe.decode(ids)


def test_licences_by_brute_force(docs, none):
    phrases = {tuple(p.split()): label for p, label in licence_scan.PHRASES.items()}
    want = []
    for r in corpus():
        words = [w.decode() for w in licence_scan.words_of(r[1])]
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        at = [i for i, _ in places]
        want.append((r[0], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = licence_scan.scan_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert plain(got.collect()) == plain(want)
    assert licence_scan.scan_licences(none).count() == 0


def test_licence_spans():
    scanner = licence_scan.LicenceScanner()
    mit = dict(licence_scan.TEMPLATES)["mit"]
    full = next(t for label, t in licence_scan.TEMPLATES if t.startswith("permission is hereby"))
    broken = full.replace("without limitation", "without any limitation").replace("merge publish", "merge or publish")
    found = scanner.scan(f"Intro words here. {broken} the end")
    assert found["labels"] == "mit" and found["base_labels"] == "" and 0.8 < found["score"] <= 1 and found["spans"][0]["start"] == 3
    assert scanner.scan("to the software and of the software in the text")["labels"] == "" and mit
    assert scanner.scan("This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl-3"


def test_matching_statistics():
    rng = random.Random(1)
    strings = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = licence_scan.SuffixAutomaton(strings)
    for _ in range(200):
        probe = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
        state = 0
        for w in probe:
            state = automaton.next[state].get(w) if state is not None else None
        ends = {(k, i + len(probe) - 1) for k, s in enumerate(strings) for i in range(len(s)) if s[i : i + len(probe)] == probe}
        assert (automaton.ends[state] if state is not None else set()) == ends


def test_quality_by_brute_force(docs, none):
    want = []
    for r in corpus():
        raw = (r[1] or "").encode()
        words = raw.split()
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in raw.split(b"\n") if x.split()]
        stats = (len(words), sum(len(w.decode()) for w in words), sum(raw.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        want.append((r[0], *stats, failed))
    orders = [list(quality_rules.MORE_RULES), list(quality_rules.MORE_RULES)[::-1], None]
    got = [plain(quality_rules.scored(docs, order=o).collect()) for o in orders]
    assert got[0] == got[1] == got[2]
    assert [g[:-1] for g in got[0]] == plain(want)
    assert quality_rules.scored(none).count() == 0
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == sum(g[-1] for g in got[0])
    assert sorted(quality_rules.cascade_order(docs)) == sorted(quality_rules.RULES)


def test_warc_round_trip(spark):
    big = "<html>" + "x" * 1500
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\n3", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "é" * 700), (8, "u", "é" * 700), (None, "u", big), (3, "http://a/3", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_archive.write_archives(pages, archive_bytes=600)
    assert index.count() == len(rows)
    records = warc_archive.read_records(index)
    got = plain(warc_archive.digests(records, "bigint").collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        best = max(j for j, _, h in rows if (h or "").encode() == raw and j is not None)
        revisit = len(raw) >= 1000 and i != best
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    assert got == plain(want)
    assert {r.page_id: bytes(r.payload) for r in warc_archive.resolved(records).collect() if r.page_id == "2"} == {"2": big.encode()}
    some = warc_archive.read_records(index.where("page_id IN ('4', '7')"), payloads=False)
    assert sorted(r.page_id for r in some.collect()) == ["4", "7"]
    assert warc_archive.read_records(warc_archive.write_archives(pages.limit(0))).count() == 0


def test_warc_ranges_and_damage():
    places = [("a", 0, 10), ("a", 12, 5), ("a", 100, 5), ("b", 0, 5)]
    assert list(warc_archive.coalesced(places, 5, 50)) == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 100, 5, [(100, 5)]), ("b", 0, 5, [(0, 5)])]
    raw = warc_archive.record_bytes(1, "u", b"payload")
    assert warc_archive.parse_record(raw)["payload"] == b"payload"
    for bad in (raw[:-1], raw.replace(b"payload", b"pay1oad"), b"junk"):
        with pytest.raises(ValueError):
            warc_archive.parse_record(bad)


def test_png_filters_and_checks():
    rng = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (9, 7, channels), dtype=np.uint8)
        for filters in (*range(5), rng.integers(0, 5, 9)):
            data = png_media.encode_png(pixels, filters)
            assert (png_media.decode_png(data) == pixels).all()
        for at in (3, 20, len(data) - 5, 40):
            with pytest.raises((ValueError, zlib.error)):
                png_media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(ValueError):
            png_media.decode_png(data[:-3])


def test_media_columns(docs, none):
    got = plain(png_media.digests(png_media.read_media(png_media.store_media(docs))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())
    assert got == plain((r[0], *png_media.digest_of(r[1])) for r in corpus())
    assert png_media.read_media(png_media.store_media(none)).count() == 0


def test_hashes_of_near_images_are_near():
    image = np.kron(np.random.default_rng(0).integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)[..., None]
    noisy = np.clip(image.astype(int) + np.random.default_rng(1).integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int.from_bytes(png_media.perceptual_hash(a)) ^ int.from_bytes(png_media.perceptual_hash(b))).count("1")
    assert apart(image, noisy) <= 6 < apart(image, np.ascontiguousarray(image.transpose(1, 0, 2)))


def brute_groups(rows, n, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1 << 20), (5, 80, 300)])
def test_ngram_join_by_brute_force(docs, none, n, percent, block):
    rows = {r[0]: r[1] for r in corpus() if r[0] is not None}
    want = brute_groups(rows.items(), n, percent)
    got = ngram_join.linked(docs, n=n, percent=percent, block_shingles=block).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join.linked(none, n=n, percent=percent).count() == 0
    if percent == 80:
        left = ngram_join.without_near_copies(docs, n=n, percent=percent)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i} | {None}


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1 << 20), (5, 80, 300)])
def test_ngram_links_by_brute_force(spark, docs, none, n, percent, block):
    texts = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    again = [(12, texts[20][1]), (12, "new words for an id of three sets"), (21, texts[11][1]), (13, None), (300, texts[25][1]), (300, texts[14][1])]
    sets = {}
    for i, text in texts + again:
        words = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    alike = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    want = {i: sum(j != i and any(alike(a, b) for a in own for b in other) for j, other in sets.items()) for i, own in sets.items()}
    more = docs.unionByName(spark.createDataFrame(again, "doc_id long, text string"), allowMissingColumns=True)
    got = ngram_join.linked(more, n=n, percent=percent, block_shingles=block, block_rows=7, count_links=True).collect()
    assert len(got) == len(corpus()) + len(again) and max(want.values()) > 5
    assert [(r, want.get(r.doc_id)) for r in got if r.n_links != (want[r.doc_id] if r.doc_id is not None and r.n_shingles else 0)] == []
    few = ngram_join.linked(more, n=n, percent=percent, block_shingles=block).collect()
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(few)
    assert ngram_join.linked(none, n=n, percent=percent, count_links=True).count() == 0
    # names of two bits are shared by nearly all sets
    assert plain(ngram_join.linked(more, n=n, percent=percent, count_links=True, name_bits=2).collect()) == plain(got)


def test_large_families_are_searched_in_rounds(spark, monkeypatch):
    """One family of sets of all sizes: blocks too different in size don't meet, and no round moves more than its share."""
    rng = random.Random(5)
    rows, text = [], []
    for i in range(60):  # each text is the last one and some words more, so neighbours link and the ends don't
        text = text + [f"w{i}x{k}" for k in range(2 + len(text) // (9 if i % 20 else 2))]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    want = brute_groups(rows, 5, 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tables, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: tables.append((name, df)) or write(df, name))
    for count in (False, True):
        tables.clear()
        got = ngram_join.linked(frame, block_shingles=2000, round_shingles=40_000, count_links=count).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        (members,) = (df for name, df in tables if name == "members")
        members = members.collect()
        moved = sum(m.n_shingles * len(m.meets) for m in members)
        assert sum(name == "found" for name, _ in tables) == math.ceil(moved / 40_000) > 2
        most = max(len({k for m in members if m.family == f for k in m.meets}) for f in {m.family for m in members})
        assert max(len(m.meets) for m in members) < most  # not every block of the family


def test_block_counts_by_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 90).astype(np.uint64)
    sets = [(k, np.unique(np.r_[base[rng.random(90) > 0.12 * rng.random()], rng.integers(0, 1 << 62, k % 9).astype(np.uint64)])) for k in range(300)]
    weights, each = {k: k % 4 for k, _ in sets}, {k for k, _ in sets if k % 50 == 0}
    for rows, others in ((sets, None), (sets[:120], sets[120:])):
        pairs = itertools.combinations(rows, 2) if others is None else itertools.product(rows, others)
        near = [(x, y) for (x, a), (y, b) in pairs if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
        want = collections.Counter()
        for x, y in near:
            want[x] += weights[y]
            want[y] += weights[x]
        got = ngram_join.block_counts(rows, others, 85, weights, each)
        assert 1000 < len(near)
        assert {a: n for kind, a, _, n in got if kind == ngram_join.SUM} == +want
        assert sorted((min(a, b), max(a, b)) for kind, a, b, _ in got if kind == ngram_join.EACH) == sorted(p for p in near if set(p) & each)
        spans, every = ([(a, b) for kind, a, b, _ in got if kind == ngram_join.SPAN], near)
        parts = lambda links: {frozenset(g) for g in connected(links)}
        assert set(spans) <= {(x, y) for x, y in near} | {(y, x) for x, y in near} and parts(spans) == parts(every)


def connected(links):
    group = {}
    for a, b in links:
        both = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(both, both))
    return group.values()


def test_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(2)
    for percent in (80, 85, 95):
        levels = ngram_join.Levels(percent)
        for _ in range(300):
            size = int(rng.integers(1, 400))
            whole = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.random(len(whole)) < rng.random() * 0.2
            more = rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 8))).astype(np.uint64)
            other = np.unique(np.r_[whole[~drop], more])
            if not len(other) or np.array_equal(whole, other):
                continue
            shared = len(np.intersect1d(whole, other))
            if 100 * shared >= percent * (len(whole) + len(other) - shared):
                for frequent in (whole[:0], whole[::2], whole):
                    frequent = np.sort(frequent)
                    assert np.intersect1d(ngram_join.keys_of(whole, levels, frequent), ngram_join.keys_of(other, levels, frequent)).size


def test_tree_gives_every_pair_within_the_bound():
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 4, (300, 8)).astype(np.int32)
    vectors[100:200] = vectors[:100] + (rng.random((100, 8)) < 0.1)
    sizes = vectors.sum(axis=1)
    tree = ngram_join.RTree(vectors, sizes)
    got = {(min(a, b), max(a, b)) for us, vs in ngram_join.tree_pairs(tree, tree, 80) for a, b in zip(us.tolist(), vs.tolist())}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if 180 * np.minimum(vectors[a], vectors[b]).sum() >= 80 * (sizes[a] + sizes[b])}
    assert got == want
    left, right = ngram_join.RTree(vectors[:40], sizes[:40]), ngram_join.RTree(vectors[40:], sizes[40:])
    cross = {(a, b + 40) for us, vs in ngram_join.tree_pairs(left, right, 80) for a, b in zip(us.tolist(), vs.tolist())}
    assert cross == {(a, b) for a, b in want if a < 40 <= b}


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (5, 5), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15), (30, 15)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **dict.fromkeys(range(15, 21), 15), 30: 15}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, window=2, modulus=3, least=2):
    cut, out = {}, {}
    for i, text in rows.items():
        lines = (text or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, now = [], []
        for k, line in enumerate(lines):
            now.append(line)
            rolled = sum(hashes[k - b] * 31**b for b in range(window) if k >= b)
            if rolled % 1_000_003 % modulus == 0 or k == len(lines) - 1:
                chunks.append(tuple(now))
                now = []
        cut[i] = chunks
    seen = set()
    for i in sorted(rows):
        left = []
        for c in cut[i]:
            if rows[i] is None or len(c) < least or c not in seen:
                left += c
                seen.add(c)
        out[i] = None if rows[i] is None else "\n".join(left)
    return out


def test_line_dedup_by_brute_force(docs, none):
    rows = {r[0]: r[1] for r in corpus() if r[0] is not None}
    want = brute_lines(rows)
    got = line_dedup.deduplicated(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"]
    found = got.collect()
    assert len(found) == len(corpus())
    for r in found:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id]
            assert r.n_lines == (len(rows[r.doc_id].split("\n")) if rows[r.doc_id] is not None else 0)
    assert any(r.n_removed for r in found)
    assert line_dedup.deduplicated(none).count() == 0


def brute_runs(rows, least=2):
    first, out = {}, {}
    for i in sorted(rows):
        lines = (rows[i] or "").split("\n")
        gone = set()
        for k in range(len(lines) - least + 1):
            j, at = first.setdefault(tuple(lines[k : k + least]), (i, k))
            if rows[i] is not None and (j != i or k - at >= least):
                gone.update(range(k, k + least))
        out[i] = None if rows[i] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_runs_go_whole(spark, docs, none):
    rng = random.Random(12)
    own = lambda n: [sentence(rng, 9) for _ in range(n)]
    runs = [own(n) for n in (2, 2, 3, 3, 4, 5, 6, 8)]
    texts = ["\n".join(own(3) + run + own(2)) for run in runs]
    inside = [(own(before), run, own(after)) for run in runs for before, after in ((0, 0), (1, 1), (4, 3), (2, 0), (0, 5))]
    texts += ["\n".join(a + run + b) for a, run, b in inside]
    got = {r.doc_id: r for r in line_dedup.without_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, (a, run, b) in enumerate(inside, len(runs)):
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == ("\n".join(a + b), len(a + run + b), len(run))
    assert all(got[i].text == texts[i] for i in range(len(runs)))

    rows = {r[0]: r[1] for r in corpus() if r[0] is not None} | {100: "a\na\na", 101: "b\nb\nb\nb\nb", 102: "x\nb\nb", 103: "a\nx"}
    more = docs.unionByName(spark.createDataFrame([(i, rows[i]) for i in range(100, 104)], "doc_id long, text string"), allowMissingColumns=True)
    for least in (2, 3):
        want = brute_runs(rows, least)
        found = line_dedup.without_runs(more, min_lines=least)
        assert found.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"]
        found = found.collect()
        assert len(found) == len(corpus()) + 4
        assert all(r.text == want[r.doc_id] for r in found if r.doc_id is not None)
    assert line_dedup.without_runs(none).count() == 0


@pytest.mark.parametrize("hash_bits", [64, 4])
def test_line_runs_whose_keys_are_shared(spark, hash_bits):
    rng = random.Random(13)
    lines = [sentence(rng, 4) for _ in range(70)]
    rows = {i: "\n".join(lines[k] for k in ([rng.randrange(70) for _ in range(9)] + list(range(at, at + 12)))) for i, at in enumerate(rng.choices(range(50), k=40))}
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows.items()], "doc_id long, text string, id_ int, r1_ int, gone_ int, kept_ string")
    want = brute_runs(rows)
    found = line_dedup.without_runs(frame, hash_bits=hash_bits)
    assert found.columns == [*frame.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == {i: (t, rows[i].count("\n") + 1 - (t.count("\n") + 1 if t else 0)) for i, t in want.items()}


def test_chunks_decide_and_windows_take_the_ends(spark):
    rng = random.Random(14)
    passage = [sentence(rng, 9) for _ in range(400)]
    frame = spark.createDataFrame([(i, "\n".join([f"own {i}", *passage, f"end {i}"])) for i in range(3)], "doc_id long, text string")
    runs = line_dedup.repeated_runs(frame, id_col="doc_id", text_col="text").collect()
    chunks, windows = ([r for r in runs if r.by == by] for by in ("chunk", "window"))
    assert sum(r.n_ for r in chunks) > 2 * 380  # both later texts lose nearly all of the passage by chunks
    within = {(r.r1_, k) for r in chunks for k in range(r.k_, r.k_ + r.n_ - 1)}
    assert windows and not within & {(r.r1_, r.k_) for r in windows}
    assert sum(r.n_removed for r in line_dedup.without_runs(frame).collect()) == 800


def test_long_texts_of_short_lines_fit_into_little_memory():
    code = """
import random
from pyspark.sql import SparkSession
from quillmesh.llm import line_dedup
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rng = random.Random(1)
text = "\\n".join(str(rng.randrange(10**12)) for _ in range(100_000))
rows = line_dedup.without_runs(spark.createDataFrame([(1, text), (2, "own\\n" + text)], "doc_id long, text string"))
print("FOUND", sorted((r.doc_id, r.n_lines, r.n_removed) for r in rows.select("doc_id", "n_lines", "n_removed").collect()))
"""
    environment = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=environment)
    assert "FOUND [(1, 100000, 0), (2, 100001, 100000)]" in said.stdout, said.stderr[-2000:]


def test_suffix_dedup_by_brute_force(spark, docs, none):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in corpus()]
    passage = sentence(rng, 40)
    rows += [(200 + k, sentence(rng, rng.randint(1, 30)) + passage[rng.randint(0, 90) :][: rng.randint(40, 150)] + "ab" * rng.randint(0, 60)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    run = lambda **o: plain(suffix_dedup.deduplicated(frame, **o).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    want = plain(suffix_dedup.brute_force(rows))
    assert run() == want
    assert run(wide_from=2, flush=50) == want
    assert suffix_dedup.deduplicated(none).count() == 0


def test_long_texts_go_in_pieces(monkeypatch, spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 400) + "same" * 30) for k in range(4)] + [(9, sentence(random.Random(9), 400))]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    found = np.concatenate([suffix_dedup.stretches([t.encode()[at : at + 349]], [i]) for i, t in rows for at in range(0, len(t) - 49, 300)])
    assert found["count"].sum() == sum(len(t) - 49 for _, t in rows)


def test_radix_passes():
    rng = np.random.default_rng(3)
    texts = rng.integers(97, 99, (400, 13), dtype=np.uint8)
    texts[200:] = texts[rng.integers(0, 200, 200)]
    docs, groups = rng.integers(0, 9, 400), rng.integers(0, 2, 400)
    keys = [(int(g), bytes(t)) for g, t in zip(groups, texts)]
    least = {}
    for k, d in zip(keys, docs):
        least[k] = min(least.get(k, d), d)
    assert suffix_dedup.equal_windows(texts, groups, docs, 13).tolist() == [bool(d > least[k]) for k, d in zip(keys, docs)]


def test_mix(docs, none):
    got = source_mix.mixed(docs).collect()
    assert plain(got) == plain(source_mix.mixed(docs.repartition(5)).collect())
    sizes = collections.Counter()
    taken = collections.Counter()
    for r, c in zip(got, got):
        assert r["size"] == len((r.text or "").split()) or "▁" in r.text
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += c.taken
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = dict(zip(order, (5, 2, 1, 5)))
    target, free = {}, set(order)
    while free:
        rest = 1.5 * total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == sizes[r.source]
    for s in order:
        assert abs(taken[s] - target[s]) <= 16
    assert source_mix.mixed(none).count() == 0
    rows = source_mix.written_out(source_mix.mixed(docs), docs.columns)
    assert rows.columns == docs.columns and sum(len((r.text or "").split()) for r in rows.collect() if "▁" not in r.text) <= sum(taken.values())


def test_mix_selects_blocks_by_seeded_rank(spark, monkeypatch):
    """Against a plain selection: a shard's row of words, its blocks in rank order, whole rows first; shards and parts."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.choice((0, 1, 5, 8, 40, 700)))), rng.choice("aab")) for i in range(60)]
    rows += [(7, "again and again", "a"), (None, "no id at all", None), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id_", F.col("doc_id")).withColumn("last_", F.lit("own"))
    for fine, words in ((4096, 100_000), (4, 200)):
        monkeypatch.setattr(source_mix, "FINE", fine)
        mix = source_mix.mixed(frame, shard_words=words)
        assert mix.columns[:5] == frame.columns
        got = mix.collect()
        assert len(got) == len(rows) and all(r.last_ == "own" and r.id_ == r.doc_id for r in got)
        texts = collections.defaultdict(list)
        for r in source_mix.written_out(mix, ["doc_id", "text"]).collect():
            texts[r.doc_id].append(r.text)
        shards = collections.defaultdict(list)
        sizes = collections.Counter()
        for r in got:
            sizes[r.source] += r["size"]
        for r in got:
            assert r.taken == r.copies * r["size"] + sum(b.words for b in r.blocks) <= 2 * r["size"]
            own = (r.text or "").split()
            want = [r.text] * r.copies
            if r.blocks:
                spans = [w for b in r.blocks for w in own[b.start : b.start + b.words]]
                want.append(r.text if len(spans) == len(own) else " ".join(spans))
            if r.doc_id not in (7, None):
                assert sorted(texts[r.doc_id]) == sorted(want if own else [])
            digest = hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            bucket, total = int(digest[:7], 16), sizes[r.source]
            shard = bucket % fine % max(1, min(fine, math.ceil(total / words)))
            part = bucket // fine % max(1, math.ceil(total / (fine * words)))
            rank = ["a", "b", None].index(r.source) + 1
            shards[rank, shard, part].append((hashlib.md5(f"mix-order|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r["size"], r))
        assert fine == 4096 or len({k[2] for k in shards}) > 1
        for key, members in shards.items():
            members.sort(key=lambda m: m[:2])
            z = sum(m[1] for m in members)
            over = sum(b.words for *_, r in members for b in r.blocks)
            salt = int(hashlib.md5("|".join(["mix", *map(str, key)]).encode()).hexdigest()[:7], 16)
            order = sorted(range(-(-z // 8)), key=lambda b: (((b * 48271 + salt + 1) % 2147483647) ** 2 % 2147483647, b))
            takes = [{b * 8 + k for n, b in enumerate(order) for k in range(8 if n < m else rest if n == m else 0) if b * 8 + k < z} for m in range(len(order) + 1) for rest in range(8)]
            at, chosen = 0, set()
            for _, size, r in members:
                chosen |= {at + b.start + k for b in r.blocks for k in range(b.words)}
                at += size
            assert over == len(chosen) and chosen in takes


def test_words_of_a_part_are_taken_out_once(spark):
    """Of a long text in many chosen blocks: some 2,500 times the text's length, if words were taken out for each block."""
    text = " ".join(f"word{k}" for k in range(40_000))
    blocks = [(k, 8) for k in range(0, 40_000, 16)]
    mix = spark.createDataFrame([(1, text, 40_000, 20_000, 0, blocks)], "doc_id long, text string, size long, taken long, copies long, blocks array<struct<start:long,words:long>>")
    began = time.time()
    (row,) = source_mix.written_out(mix, ["doc_id", "text"]).collect()
    assert time.time() - began < 10
    own = text.split()
    assert row.text.split() == [w for start, n in blocks for w in own[start : start + n]]


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 250):
        votes = [(g, k, float(rng.randint(0, 1000))) for g in range(3) for k in range(9)]
        frame = spark.createDataFrame(votes, "g int, k int, v double")
        got = {(r.g, r.k): r.seats_ for r in source_mix.apportioned(frame, ["g"], ["k"], "v", F.lit(seats)).collect()}
        for g in range(3):
            own = {k: v for x, k, v in votes if x == g}
            won = dict.fromkeys(own, 0)
            for _ in range(seats):
                best = min((k for k in own if own[k] > 0), key=lambda k: (-own[k] / (2 * won[k] + 1), k))
                won[best] += 1
            assert {k: got[g, k] for k in own} == won


def test_counterfactuals_spare_neutral_mentions():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1500):
        toxic = rng.random() < 0.3
        words = set(rng.sample(WORDS, 8))
        if toxic and rng.random() < 0.6:  # the rest is toxic in ways that no word shows
            words.add(rng.choice(["insulta", "insultb"]))
        named = rng.random()  # toxic texts name one group, others mostly its counterpart
        if named < (0.5 if toxic else 0.05):
            words.add("muslim")
        elif named < (0.55 if toxic else 0.5):
            words.add("christian")
        texts.append(words)
        labels.append(int(toxic))
    plainly = toxicity.train(texts, np.array(labels), counterfactual_weight=0.0)
    fairly = toxicity.train(texts, np.array(labels))
    neutral, other = {"alpha", "muslim", "beta"}, {"alpha", "christian", "beta"}
    gap = lambda w: abs(toxicity.score_words(neutral, w) - toxicity.score_words(other, w))
    assert gap(fairly) < 0.05 < gap(plainly)
    assert toxicity.score_words({"alpha", "insulta"}, fairly) > 0.7 > 0.5 > toxicity.score_words(neutral, fairly)
    assert toxicity.counterfactual({"muslim", "x"}) == {"christian", "x"} and toxicity.counterfactual({"x"}) is None


def test_toxicity_on_tables(spark, docs, none):
    rng = random.Random(6)
    texts = [(i, sentence(rng, 30) + (" vile scoundrel" if i % 4 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    weights = toxicity.fit(frame, labels)
    got = toxicity.scored(frame, weights).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) == int(r.doc_id % 4 == 0)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(frame, flipped) == weights  # labels that are held out teach nothing
    assert toxicity.scored(docs, weights).count() == len(corpus()) and toxicity.scored(none, weights).count() == 0
    assert list(toxicity.fit(frame, labels.limit(0))) == [""]


def test_levels_of_long_texts_cost_little():
    from quillmesh.llm.ngram_join import Levels

    looked, tail = [], Levels._tail
    levels = Levels(80)
    levels._tail = lambda *a: looked.append(a) or tail(*a)
    levels.of(20_000)
    assert len(looked) < 2_000
    for low, high, (groups, extra) in zip(levels.starts, levels.starts[1:], levels.groups):
        differ = (high - 1 + 100 * (high - 1) // 80) * 20 // 180
        if 0 < differ < 200:
            chance = [tail(low, differ + 1 + e, e) for e in range(differ + 6)]
            want = next((e for e, c in enumerate(chance) if c <= levels.miss), chance.index(min(chance)))
            assert (groups, extra) == (differ + 1 + want, want)
