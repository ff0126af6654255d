"""The pipeline stage by stage against brute force, each on what the stage before kept."""

from collections import Counter

import numpy as np
from test_decontamination import plain as plain_hits
from test_near_copies import firsts
from test_suffix_dedup import plain as plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from heliograph.llm import queries
from heliograph.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    benchmark = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    scores = {r.doc_id: r.score for r in queries.op3_toxicity(spark, sf).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = written(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            break
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        after = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
        if name == "toxicity":
            want = [r for r in before if scores[r[0]] < 0.5]
        elif name == "near_duplicates":
            want = [r for r, first in zip(before, firsts(before)) if r[0] == first]
        elif name == "repeated_passages":
            want = [(d, kept.decode("utf-8", "ignore")) for d, _, _, kept in plain_repeats(before)]
        else:
            want = [r for r, found in zip(before, plain_hits(before, benchmark)) if not found[2]]
        assert after == Counter(want)
        assert 0 < len(want) <= len(before)
        docs = out
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in before)
    pieces = out.collect()
    assert sum(p.length for p in pieces) == tokens and {p.doc_id for p in pieces} == {d for d, _ in before}
    assert np.unique([(p.sequence_id, p.offset) for p in pieces], axis=0).shape[0] == len(pieces)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"
    ]


def test_nulls_and_repeated_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words without id", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() in (0, 3)
