"""Runs of words against the comparison of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from heliograph.llm import periodic_runs, queries
from heliograph.llm.common import table


def plain_runs(x):
    """(start, length, period) of all runs, by comparing each word with those behind it."""
    n, found = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.append((s, i + q - s, q))
            i += i == s
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and sum(o[:2]) >= sum(r[:2]) for o in found))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        x = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.5:
            a, p = rng.randrange(len(x)), rng.randrange(1, 15)
            for i in range(a + p, len(x)):
                x[i] = x[i - p]
        yield np.array(x, np.int64)


def test_groups_are_the_longest_lyndon_words():
    for x in sequences(1, 300):
        group, length = periodic_runs.lyndon_groups(x)
        s, n = x.tolist(), len(x)
        words = []
        for i in range(n):
            end = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
            assert length[i] == end - i
            words.append(tuple(s[i:end]))
        assert len(set(zip(group.tolist(), words))) == len(set(group.tolist())) == len(set(words))


def test_runs_of_random_sequences():
    for x in sequences(2, 2000):
        inside = periodic_runs.repeated_stretches(x, np.array([len(x)]))
        assert periodic_runs._document_runs(x, inside) == plain_runs(x.tolist()) == periodic_runs.runs_of(x)


@pytest.mark.parametrize("size", [1000, 100_000])
def test_long_runs(size):
    assert periodic_runs.runs_of(np.zeros(size, np.int64)) == [(0, size, 1)]
    x = np.tile(np.arange(size // 10), 10)
    assert periodic_runs.runs_of(x) == [(0, len(x), size // 10)]


def test_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x y " * 7, "A a " * 8, "no run here", "w " * 5000 + "v", "p q r " * 40 + "\x0b" + "p q s " * 40, "é è " * 9]
    # Ids on both sides of the rule that plants runs, one more than once.
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(i, "lorem ipsum dolor sit amet consectetur " * (i % 3 + 1), "k", 2) for i in range(100, 160)] + [(None, "a " * 9, "k", 3), (5, texts[5], "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    got = periodic_runs.periodic_runs(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), plain_runs((t or "").encode().split())) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), [(x.start, x.length, x.period) for x in r.runs]) for r in got) == want
    assert periodic_runs.periodic_runs(df.limit(0), ["doc_id"]).count() == 0


def test_query_on_given_documents(spark, sf):
    for path in (sf, sf.replace("sf0.001", "sf0.01")):
        docs = [(r.doc_id, r.text) for r in table(spark, path, "documents").collect()]
        got = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, path).collect()}
        assert len(got) == len(docs)
        short = [(d, t) for d, t in docs if len((t or "").split()) < 700]
        assert sum(got[d][0] > 0 for d, _ in short) > 10
        for d, t in short:
            assert got[d] == plain_row(d, t)
