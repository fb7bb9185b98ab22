"""The pipeline's stages one after the other, each against a plain version on its own input."""

import hashlib
import re

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_runs, corpus, plain

from quillmesh.llm import quality_rules, source_mix
from quillmesh.llm.queries import piece_model


def test_stages(spark, tmp_path):
    import sentencepiece

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([r[:5] for r in corpus() if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "encode"]
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id: r.text for r in state.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_before, out = state, stage(spark, state, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        rows = state.collect()
        if k < 4:
            assert state.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows if k)
        if name == "quality":
            want = {i for i, t in before.items() if quality_rules.rejected_by(quality_rules.Page(t), list(quality_rules.RULES), quality_rules.RULES) is None}
            assert {r.doc_id for r in rows} == want
        elif name == "lines":
            assert {r.doc_id: r.text for r in rows} == brute_runs(before)
        elif name == "near_copies":
            assert {r.doc_id for r in rows} == {i for i, (_, c) in brute_groups(before.items(), 5, 80).items() if c == i}
        elif name == "mix":
            want = []
            for m in source_mix.mixed(docs_before).collect():
                own = re.findall(source_mix.WORD, m.text)
                want += [(m.doc_id, m.text)] * m.copies if own else []  # a text without words gives no row
                chosen = [w for b in m.blocks for w in own[b.start : b.start + b.words]]
                want += [(m.doc_id, m.text if len(chosen) == len(own) else " ".join(chosen))] if chosen else []
            assert rows and plain((r.doc_id, r.text) for r in rows) == plain(want)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
            want = []
            for r in mixed:
                ids = sp.encode(r.text, add_eos=True)
                want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
            assert plain(rows) == plain(want)
        if k < 3:
            before = {r.doc_id: r.text for r in rows}
        mixed = rows
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert plain(whole) == plain(rows)
