"""The near-duplicate stage does nothing without an effect, and its memory is bounded by bytes of text."""

import pyarrow as pa

from heliograph.llm import minmax, near_copies, simhash


def test_no_candidates_without_effect(spark, monkeypatch):
    def unused(*_):
        raise AssertionError("SimHash groups add no link that the bands don't find")

    monkeypatch.setattr(simhash, "linked_classes", unused)
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(2, " ".join(words)), (1, " ".join([*words, "x"])), (3, "other text")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_copies.near_copy_groups(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_pieces(monkeypatch):
    monkeypatch.setattr(minmax, "SLICE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 25, "", "c" * 5, "d" * 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    pieces = [p.column(0).to_pylist() for p in minmax._pieces(iter([batch, batch.slice(0, 0)]), 0)]
    assert sum(pieces, []) == texts
    assert all(sum(len(t or "") for t in p) <= 10 + 25 for p in pieces)
    assert [len(p) for p in pieces] == [2, 2, 3, 0]
