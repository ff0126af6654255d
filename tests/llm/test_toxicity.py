"""Folding, matching, learning, and accuracy on the held-out fold."""

import zlib

import pytest

from heliograph.llm import queries, toxicity
from heliograph.llm.toxicity import START, WHOLE, Lexicon, Matcher


@pytest.mark.parametrize("text", ["idiot", "IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "1DI0Т"])
def test_folding(text):
    assert toxicity.fold(text) == "idiot"


def test_matching():
    lexicon = Lexicon({("scum", WHOLE): 2.0, ("idio", START): 1.0, ("idiot", WHOLE): 3.0}, {"idiom", "scum of iron"})
    weight = lambda text: Matcher(lexicon).weight(text)
    assert weight("scum") == (2.0, 1)
    assert weight("scums ascum scum!") == (2.0, 3)
    assert weight("idiot idiotic idiom") == (4.0, 3)
    assert weight("a scum of iron, scum") == (2.0, 5)
    assert weight(None) == weight("") == (0.0, 0)
    assert weight("1d10t " * 50_000) == (150_000.0, 50_000)


def documents(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        text = f"calm words about river{i % 7} and stone{i % 5} go on " + ("you vile1 v1lest thing" if toxic else "with vilespire hills")
        rows.append((i, text, "en"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "vilest vilest", "en"), (1002, "calm words " * 40_000, "en"), (0, rows[0][1], "en")]
    labels += [(5000, 1), (None, 1), (7, None)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_learning(spark):
    docs, labels = documents(spark)
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert any(text.startswith("vile") for text, _ in lexicon.entries)
    scored = toxicity.score_toxicity(docs, lexicon, ["doc_id"]).collect()
    assert len(scored) == docs.count()
    by = {}
    for r in scored:
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert all((min(by[i]) >= 0.5) == (i % 8 == 0) for i in range(400))
    assert min(by[None]) > 0.5 > max(by[1000] | by[1001] | by[1002])


def test_nothing_to_learn_from(spark):
    docs, labels = documents(spark)
    for known in (labels.limit(0), labels.filter("toxic = 0")):
        lexicon = toxicity.learn_lexicon(docs, known)
        assert {r.score for r in toxicity.score_toxicity(docs, lexicon, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), lexicon, ["doc_id"]).count() == 0


def test_query_on_the_held_out_fold(spark, sf):
    rows = queries.op3_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) / len(held) > 0.85


def test_labels_of_fold_0_are_not_used(spark):
    docs, labels = documents(spark)
    rows = toxicity.train_rows(labels).collect()
    assert all(zlib.crc32(str(r._id).encode()) % 5 for r in rows) and len(rows) > 250
