"""The pipeline's stages, one after the other."""

import corpus_pipeline as pipeline


def test_stages(spark, sf_dir, docs):
    held, counts = docs, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        held = pipeline.materialize(stage(spark, held, sf_dir), "pipeline-test")
        assert held.columns == docs.columns
        counts.append(held.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[-1] > 0
    packed = pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark, sf_dir, odd_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0)):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
