"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliograph.llm import minmax, near_copies
from heliograph.llm.common import table


def plain_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def firsts(rows):
    """The smallest id of each row's group."""
    sets, parent = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            small, large = sorted((len(x), len(sets[j])))
            if 5 * small >= 4 * large and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


def edited(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def frame(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "one two", "One TWO", "one two three four five", " ".join(words)]
    # Copies that are near the whole text but not near each other, and ones about the limit.
    texts += [edited(words, {k + 7 * j for j in range(6)}) for k in range(0, 300, 25)]
    texts += [edited(words, {13 * j for j in range(n)}) for n in (8, 9, 10)]
    texts += ["a common line of ten words that many texts have " + " ".join(f"x{i}y{k}" for k in range(30)) for i in range(60)]
    rows = [(200 - i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (None, "alone"), (200, None), (3, "other text"), (3, "other text")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("stars", [2, 0])
def test_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(minmax, "STARS", stars)
    df, rows = frame(spark)
    df = df.select("*", F.lit(1).alias("_row"), F.lit(2).alias("_stays"))
    got = near_copies.near_copy_groups(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, f) for (d, _), f in zip(rows, firsts(rows)))
    kept = near_copies.first_of_each_group(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict.fromkeys(firsts(rows), 1))
    assert near_copies.first_of_each_group(df.limit(0)).count() == 0


def test_stage_on_given_documents(spark, sf):
    for path in (sf, sf.replace("sf0.001", "sf0.01")):
        docs = table(spark, path, "documents")
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, path).collect()}
        assert kept == set(firsts(rows))


def test_workers_keep_nothing(spark):
    """The worker that runs after another operator's task drops its state, and says so from within."""
    from heliograph.llm.common import leaving_nothing, worker_state

    def held(batches):
        import sys

        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["_heliograph_worker" in sys.modules] * len(batch))], names=["held"])

    def keeps(batches):
        worker_state("test", lambda: bytearray(1 << 20))
        yield from held(batches)

    rows = spark.range(8, numPartitions=1)
    assert {r.held for r in rows.mapInArrow(keeps, "held boolean").collect()} == {True}
    assert {r.held for r in rows.mapInArrow(leaving_nothing(held), "held boolean").collect()} == {False}


def test_no_rows_from_python_in_links(spark, monkeypatch):
    """Empty tables of links come from Spark's range, not from a Python list."""
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    texts = [f"{i} " + " ".join(f"w{k}" for k in range(40)) for i in (1, 2)]
    docs = spark.range(1, 3).selectExpr("id AS doc_id", f"CASE id WHEN 1 THEN '{texts[0]}' ELSE '{texts[1]}' END AS text")
    assert {r.component_id for r in near_copies.near_copy_groups(docs).collect()} == {1}
