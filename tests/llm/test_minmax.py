"""Min-max near duplicates against the similarity of all pairs."""

from collections import defaultdict

import numpy as np
import pytest
from test_near_copies import edited, plain_sets

from heliograph.llm import minmax, queries
from heliograph.llm.common import table


def plain(rows):
    """(doc_id, shingles, smallest id reachable, kept) of each row."""
    sets, parent = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            small, large = sorted((len(x), len(sets[j])))
            if small and 100 * small >= 85 * large and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = [min((d for d in groups[find(i)] if d is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted([(d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, least)], key=str)


def found(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def copies():
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "one two", "One TWO", "one two three four five", "x y", " ".join(words)]
    # Copies that are near the whole text but not near each other, and ones about the limit.
    texts += [edited(words, {k + 7 * j for j in range(4)}) for k in range(0, 300, 25)]
    texts += [edited(words, {13 * j for j in range(n)}) for n in (5, 6, 7, 8)]
    # A third has a common line, not enough to be similar.
    texts += ["a common line of ten words that many texts have " + " ".join(f"x{i}y{k}" for k in range(30)) for i in range(20)]
    texts += ["long " * 40_000, "long " * 39_999 + "end"]
    return [(200 - i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, "alone"), (200, None), (3, "other text"), (3, "other text")]


@pytest.mark.parametrize("stars", [2, 0])
def test_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(minmax, "STARS", stars)
    rows = copies()
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, sig int, band string, root string")
    assert found(minmax.minmax_groups(df)) == plain(rows)
    assert minmax.minmax_groups(df.limit(0)).count() == 0


def test_a_third_in_one_group(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(words, {i % 120})) for i in range(300)] + [(1000 + i, " ".join(f"o{i}x{k}" for k in range(50))) for i in range(300)]
    rows += [(5000 + i, rows[400][1]) for i in range(300)]
    got = {r.doc_id: r.component_id for r in minmax.minmax_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[5000 + i] == rows[400][0] for i in range(300))
    assert sum(d == c for d, c in got.items()) == 301


def test_values_estimate_the_similarity():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    for share in (0.5, 0.85):
        # Of two sets of equal size, `share` of the union is common.
        n = len(whole)
        a, b = whole[: int(n * (1 + share) / 2)], whole[int(n * (1 - share) / 2) :]
        same = []
        for k in range(minmax.BANDS * minmax.DEPTH):
            x, y = a * minmax.FACTORS[k] + minmax.OFFSETS[k], b * minmax.FACTORS[k] + minmax.OFFSETS[k]
            same += [x.min() == y.min(), x.max() == y.max()]
        assert abs(np.mean(same) - share) < 0.12
        if share == 0.85:
            assert (minmax.band_keys([a]) == minmax.band_keys([b])).any()


def test_query_on_given_documents(spark, sf):
    for path in (sf, sf.replace("sf0.001", "sf0.01")):
        rows = [(r.doc_id, r.text) for r in table(spark, path, "documents").collect()]
        assert found(queries.op13_minmax_near_dedup(spark, path)) == plain(rows)
