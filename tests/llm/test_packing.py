"""Packing against the tokenizer itself and the rules of the sequences."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from heliograph.llm import packing, queries

TEXTS = [
    None, "", " \t\n ", "Hello, World!!", "it's a naïve İstanbul ﬁne ÉCOLE don't 123abc x_y", "a" * 9000,
    "word " * 5000, "<|endoftext|> end <|startoftext|>", "e\u0301 \u00a0 \x1c \u2003 ü.,;", "same", "same",
    "日本語 テスト。", "ǅ Ω ſ \U0001f600 $$$ %%%&&&", "The*** the*** THE!!",
]


def frame(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def check(pieces, texts, tokenizer, window):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        assert b"".join(bytes(p.tokens) for p in own) == ids
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert {p.doc_tokens for p in own} == {len(ids) // 4}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) <= window
    return by_sequence


def test_ids_and_sequences(spark, tokenizer):
    df = frame(spark, TEXTS).coalesce(1)
    pieces = packing.pack_documents(df, queries.tokenizer_path(), window=64).collect()
    sequences = check(pieces, TEXTS, tokenizer, 64)
    fills = sorted(sum(p.length for p in s) for s in sequences.values())
    assert all(f == 64 for f in fills[1:])


def test_open_windows_are_bounded_and_none_is_lost(spark, tokenizer):
    texts = [" ".join(["the"] * (30 + i % 7)) for i in range(300)]
    pieces = packing.pack_documents(frame(spark, texts).coalesce(1), queries.tokenizer_path(), 64, max_open=5)
    check(pieces.collect(), texts, tokenizer, 64)


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    levels = packing.LevelArray(20)
    for _ in range(400):
        size = int(rng.integers(1, 20))
        level = levels.level_for(size)
        sums = {}
        for h in range(0, 21 - size):
            if h and not levels.count[h]:
                continue
            after = levels.count.copy()
            after[h] -= h > 0
            after[h + size] += 1
            sums[h] = int((after[1:20] ** 2).sum())
        assert sums[level] == min(sums.values())
        levels.place((("d", b""), 0, size))


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_query(spark, sf, tokenizer):
    rows = queries.op1_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows[:200]:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        own = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(own), len(ids))
    used = sum(r.length for r in rows)
    assert used / (4096 * len({r.sequence_id for r in rows})) > 0.95
