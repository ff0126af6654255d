"""Repeated passages against a plain dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from heliograph.llm import queries, suffix_dedup


def plain(rows):
    """(doc_id, n_bytes, spans, kept) per row."""
    first = {}
    for doc_id, text in rows:
        data, own = (text or "").encode(), float("inf") if doc_id is None else doc_id
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            if own < first.get(s, (own + 1) if own != float("inf") else float("inf")) or s not in first:
                first[s] = min(own, first.get(s, own))
    out = []
    for doc_id, text in rows:
        data, own = (text or "").encode(), float("inf") if doc_id is None else doc_id
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < own:
                gone[i : i + 50] = b"\1" * 50
        spans, kept = [], bytes(b for b, g in zip(data, gone) if not g)
        for i, g in enumerate(gone):
            if g and (not i or not gone[i - 1]):
                spans.append([i, i + 1])
            elif g:
                spans[-1][1] = i + 1
        out.append((doc_id, len(data), tuple(map(tuple, spans)), kept))
    return out


def compare(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, kept string, n_chars int")
    got = suffix_dedup.remove_repeats(df, ["doc_id"], **sizes).collect()
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == Counter(plain(rows))


def passages(seed, n, alphabet="abcdefgh é\n"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        text = " ".join(parts)
        cut = rng.randrange(len(text) + 1) if rng.random() < 0.3 else 0
        rows.append((i * 7 % n, text[cut:]))
    return rows


@pytest.mark.parametrize("block_bytes,shard_anchors", [(1 << 30, 1 << 30), (3000, 5), (800, 1)])
def test_passages(spark, block_bytes, shard_anchors):
    compare(spark, passages(block_bytes, 60), block_bytes=block_bytes, shard_anchors=shard_anchors)


def test_edges(spark):
    fifty = "".join(chr(97 + i % 26) for i in range(50))
    rows = [(5, fifty), (3, fifty), (9, "x" + fifty + "y"), (8, fifty[:49]), (3, fifty), (None, fifty), (None, fifty), (2, None), (1, ""), (4, "a" * 300), (6, "a" * 51), (7, "a" * 49), (10, "ab" * 100), (11, "ba" * 80), (12, "\x00" * 70), (13, "\x00" * 60 + "z"), (14, "é" * 40), (15, "xé" + "é" * 40), (16, None)]
    compare(spark, rows)
    compare(spark, rows, block_bytes=100, shard_anchors=1)
    compare(spark, [])


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 257)
    rows = passages(3, 20) + [(100 + i, t * 9) for i, t in passages(4, 6)]
    compare(spark, rows, block_bytes=5000, shard_anchors=20)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(2)
    for count in (1, 2, 3, 7):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))).encode() for _ in range(rng.randrange(12))) for _ in range(count)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        shared = [bytes(common(a, b) for a, b in zip([b"", *r], r)) for r in runs]
        got = list(suffix_dedup.merge_runs(runs, shared))
        strings = [runs[r][i] for r, i, _ in got]
        assert strings == sorted(x for r in runs for x in r)
        assert [n for *_, n in got][1:] == [common(a, b) for a, b in zip(strings, strings[1:])]


def test_front_coding():
    words = sorted([b"abc", b"abd", b"abdeff", b"x"])
    assert list(suffix_dedup.decode_run(bytes([3, 3, 6, 1]), bytes([0, 2, 3, 0]), b"abcdeffx")) == words


def test_every_string_has_one_anchor():
    data = np.frombuffer(("the quick brown fox " * 20 + "jumps over " * 9).encode(), np.uint8)
    own = suffix_dedup.Anchors(data, np.array([len(data)]))
    strings = [s for a, b in zip(own.first, own.last) for s in range(a, b + 1)]
    assert sorted(strings) == list(range(len(data) - 49))
    assert all(b <= p and p + suffix_dedup.GRAM <= a + 50 for a, b, p in zip(own.first, own.last, own.place))


def test_texts_without_repeats(spark):
    rows = passages(9, 30)
    df = spark.createDataFrame([(i, t, len(t), "kept") for i, t in rows], "doc_id long, text string, n_chars long, kept string")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    want = Counter((d, k.decode("utf-8", "ignore")) for d, _, _, k in plain(rows))
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) and r.kept == "kept" for r in got)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    want = {(d, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in plain(rows)}
    assert {tuple(r) for r in queries.op4_suffix_dedup(spark, sf).collect()} == want
    assert sum(w[2] > 0 for w in want) > 10
