"""The pipeline: every stage over all that its predecessor kept, and the whole run."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from webreach.llm import decontam, forest, lines, packing, quality
from webreach.llm.common import table

from . import cases

NAMES = ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_operators(spark):
    docs, labels, bench = (table(spark, cases.SF, t) for t in ("documents", "labels", "benchmark"))
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], cases.SF).cache())
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in steps]
    texts = [dict(cases.pairs(df)) for df in steps[:-1]]
    kept = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).filter("kept").select("doc_id").collect()}
    assert ids[1] == kept and len(kept) > 500
    deduped = {r.doc_id: r.text for r in lines.dedup(steps[1]).select("row.doc_id", "text").collect()}
    assert texts[2] == deduped and ids[2] == ids[1]
    first = {r.doc_id for r in forest.join(steps[2]).filter("is_first").select("doc_id").collect()}
    assert ids[3] == first
    leaky = {r.doc_id for r in decontam.find(steps[3], bench).select("doc_id").collect()}
    assert ids[4] == ids[3] - leaky and leaky
    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = steps[5].collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in texts[4].items()}
    assert sorted(tokens) == sorted(ids[4])
    run = corpus_pipeline.run(spark, cases.SF)
    assert run.columns == steps[5].columns
    assert run.agg({"length": "sum"}).first()[0] == int(np.sum([p.length for p in pieces]))


def test_stages_on_odd_rows(spark):
    df = cases.frame(spark, cases.edge_rows() + [(70 + i, cases.words(70 + i, 60)) for i in range(5)])
    for rows in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, cases.SF)
            assert name == NAMES[-1] or out.columns == df.columns
            rows = out
        rows.count()


def test_clean_documents_stay(spark):
    docs = table(spark, cases.SF, "documents")
    good = {r.doc_id for r in table(spark, cases.SF, "labels").filter("quality = 1").collect()}
    leaky = {r.doc_id for r in decontam.find(docs, table(spark, cases.SF, "benchmark")).collect()}
    left = {r.doc_id for r in corpus_pipeline.run(spark, cases.SF).select("doc_id").distinct().collect()}
    own = {r.doc_id for r in forest.join(docs).filter("n_links = 0 and n_copies = 1").collect()}
    clean = (good & own) - leaky
    assert len(clean - left) <= 0.03 * len(clean)
