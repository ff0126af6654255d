"""Decontamination against a plain search."""

import hashlib
import random
import re
from collections import Counter

from heliograph.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), tuple(sorted(found))))
    return out


def compare(spark, docs, items, size=10):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, item_id string, words string")
    i = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = decontamination.contamination(d, i, size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in got) == Counter(plain(docs, items, size))
    kept = decontamination.without_contaminated(d, i, size)
    assert kept.columns == d.columns
    clean = Counter(r[:2] for r, p in zip(docs, plain(docs, items, size)) if not p[2])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean


def test_edges(spark):
    ten = "Alpha beta, gamma-delta EPSILON zeta eta theta iota kappa"
    items = [(1, ten), (2, "short é item"), (3, ""), (4, None), (5, "!!!"), (2, "short é item"), (None, "without an id"), (6, "the " * 30), (7, ten + " lambda mu")]
    docs = [
        (1, ten), (2, ten.upper()), (3, None), (4, ""), (5, "... !"), (6, "x " + ten.replace(" ", "\n") + "y"), (7, "a short É item"),
        (8, "a short é item, short é item"), (9, "the " * 9), (10, "the " * 10), (11, "the " * 500 + ten), (12, "without an id"),
        (1, ten), (None, ten), (None, "clean"), (1, "another text"), (13, ten + " " + ten + " lambda"), (14, "kappa " * 40), (15, "filler " * 60_000 + ten),
    ]
    compare(spark, docs, items)


def test_random_texts(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    compare(spark, [(i, text(rng.randrange(60))) for i in range(120)], [(i, text(rng.randrange(9))) for i in range(25)], size=4)


def test_empty_tables(spark):
    compare(spark, [], [(1, "some words")])
    compare(spark, [(1, "some words")], [])


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    want = {
        (d, n, h, k, hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0) for d, n, h, k, found in plain(docs, items)
    }
    assert {tuple(r) for r in queries.op10_decontamination(spark, sf).collect()} == want
    assert sum(h > 0 for _, _, h, _, _ in plain(docs, items)) > 0


def test_hot_word(spark):
    """One word is the rarest of hundreds of windows and stands in a third of all documents."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, f"{text(4)} hot {text(4)}") for i in range(300)]
    docs = [(i, " ".join([text(5), "hot", text(5)]) if i % 3 else text(30)) for i in range(300)]
    docs += [(1000 + k, "x " + items[k][1] + " hot") for k in range(20)]
    compare(spark, docs, items)
    windows = decontamination.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    counts = decontamination.rarity(spark.createDataFrame(docs, "doc_id long, text string"), windows.selectExpr("explode(window) word").distinct())
    keys = decontamination.paired_windows(decontamination.keyed_windows(windows, counts))
    assert keys.groupBy("pair").count().agg({"count": "max"}).first()[0] < 300 // 2


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "a", "b", "c"), (2, "three", "a", "b", "c")], "doc_id long, text string, _id string, _hash string, place string")
    items = spark.createDataFrame([(7, "ONE two")], "item_id long, text string")
    kept = decontamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
