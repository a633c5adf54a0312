"""The pipeline's stages against brute force, and on odd tables."""

import corpus_pipeline
from weftgraph.llm import decontaminate, mixing, quality
from weftgraph.llm.common import saved

from .test_operators import DOCS, jaccard_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    good = saved(corpus_pipeline.quality(spark, docs, sf), "t")
    assert good.columns == docs.columns
    verdict = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict
    single = saved(corpus_pipeline.near_duplicates(spark, good, sf), "t")
    comps = jaccard_components([(i, rows[i]) for i in sorted(verdict)])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in comps.items() if i == c}
    clean = saved(corpus_pipeline.decontamination(spark, single, sf), "t")
    hit = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    mixed = corpus_pipeline.mixing(spark, clean, sf)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.token_output(spark, saved(mixed, "t"), sf).orderBy("start").collect()
    blocks = mixing.mix_sources(clean).orderBy("mix_block", "mix_key").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in blocks] and len({r.start for r in out}) == len(out)


def test_odd_tables(spark, sf):
    rows = [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "the of and " * 30 + "x", "en", None, 1), (2, "the cat of and to a in is that it for on as with by was be at this from an or he she they we you", "en", "b", 9)]
    for df in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            df = saved(stage(spark, df, sf), f"odd-{name}")
            df.count()
