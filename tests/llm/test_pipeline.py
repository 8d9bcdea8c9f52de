import numpy as np

import corpus_pipeline
from corpusloom.llm import bpe, crf, line_dedup, mixing, simhash


def test_stages_by_steps(spark, tiny_dir):
    """run() is the stages one after another; each keeps documents' columns."""
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    columns, now = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, tiny_dir).toPandas()
        assert list(after.columns) == columns
        before = now.toPandas()
        if name == "quality":
            model = crf.train(docs, spark.read.parquet(f"{tiny_dir}/labels.parquet"))
            assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text, strict=True) if model.score(t) >= crf.THRESHOLD}
        if name == "line_dedup":
            assert (after.n_chars == after.text.str.len()).all()
            assert len(after) <= len(before)
        if name == "simhash":
            sets = {d: set(simhash.shingle_hashes(simhash._tokens(t), 5).tolist()) for d, t in zip(before.doc_id, before.text, strict=True)}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            left, ids = set(after.doc_id), sorted(sets)
            pairs = [(a, b) for i, b in enumerate(ids) for a in ids[:i] if near(a, b)]
            assert not [p for p in pairs if set(p) <= left]
            assert left >= set(ids) - {x for p in pairs for x in p}
        if name == "mixing":
            taken = {r.doc_id: r.taken // r.size for r in mixing.mixing_report(now).collect() if r.size}
            assert after.groupby("doc_id").size().to_dict() == {d: n for d, n in taken.items() if n}
        now = spark.createDataFrame(after, docs.schema)
    rows = corpus_pipeline.run(spark, tiny_dir).collect()
    e = bpe.encoder(*bpe.default_tokenizer())
    texts = {r.doc_id: r.text for r in now.collect()}
    assert len(rows) == now.count()
    for r in rows:
        assert e.decode(bytes(r.ids)).decode() == texts[r.doc_id]
        assert r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4"))
    assert line_dedup.dedup_lines(now.limit(0)).count() == 0
