"""SimHash against a plain computation over all pairs."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from heliograph.llm import components, queries, simhash


def plain_fingerprint(text):
    words, out, word = [], bytearray(), b""
    for byte in (text or "").encode() + b" ":
        if byte == 0x20 or 0x09 <= byte <= 0x0D:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


TEXTS = [None, "", " \t\x0b\n", "one", "One TWO", "one two", "É é x one two three", "one two three four", "the " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


@pytest.mark.parametrize("n,radius", [(1, 2), (2, 2), (63, 2), (65, 1), (700, 2), (600, 3), (600, 0)])
def test_bit_sliced_comparison(n, radius):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, size=8, dtype=np.uint64)
    prints = centres[rng.integers(0, 8, n)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    prints = np.unique(prints)
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(prints, radius) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    assert got == want


def test_large_buckets_are_divided(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 16)
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 12, 500, dtype=np.uint64) << np.uint64(20))
    links = [pair for u, v in simhash.forest(prints, list(range(64)), 2) for pair in zip(u.tolist(), v.tolist())]
    assert all((u ^ v).bit_count() % 1 == 0 for u, v in links)
    ids = list(range(len(prints)))
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[find(u)] = find(v)
    want = roots(ids, [int(p) for p in prints], 2)
    assert len({find(int(p)) for p in prints}) == len(set(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 120)] + [(500, 400), (400, 450), (7, 7), (900, 901), (901, 900)]
    star = [(10_000, 10_001 + i) for i in range(500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 121)} | {450: 400, 500: 400, 901: 900} | {10_001 + i: 10_000 for i in range(500)}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def frame(spark):
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS) + [" ".join(words)] * 6
    for k in range(12):
        some = list(words)
        some[k * 30] = "changed"
        texts.append(" ".join(some))
    texts += [" ".join(reversed(words)), "one  TWO"]
    rows = [(100 - i, t, "z") for i, t in enumerate(texts)] + [(None, texts[9], "z"), (None, "alone here", "z"), (100, None, "z"), (3, "other", "z"), (3, "other", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string"), rows


def test_groups_equal_all_pairs(spark):
    df, rows = frame(spark)
    want = roots([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows], 2)
    got = simhash.simhash_groups(df).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(
        (r[0], plain_fingerprint(r[1]), w) for r, w in zip(rows, want)
    )


def test_one_of_each_group_stays(spark):
    df, rows = frame(spark)
    kept = simhash.first_of_each_group(df)
    assert kept.columns == df.columns
    want = roots([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows], 2)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict.fromkeys(want, 1))
    assert simhash.first_of_each_group(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = queries.table(spark, sf, "documents").collect()
    want = roots([d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs], 2)
    expected = {d.doc_id: (f"{plain_fingerprint(d.text):016x}", w) for d, w in zip(docs, want)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf).collect()} == expected
