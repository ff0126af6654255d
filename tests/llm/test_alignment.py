"""Alignment of two tokenizers against plain loops over all their tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heliograph.llm import alignment, queries
from heliograph.llm.common import table

PATHS = (queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECE_BPE))


@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_table():
    """Characters of byte-level entries: printable ones are themselves, the rest come from 256 on."""
    out, more = {}, 256
    for c in range(256):
        if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174:
            out[chr(c)] = c
        else:
            out[chr(more)], more = c, more + 1
    return out


def plain_tokens(both, text):
    """(id, bytes) of each token of both, none where bytes differ from the text's."""
    first, second = both
    whole, chars = " " + (text or ""), byte_table()
    a = [(i, bytes(chars[c] for c in first.id_to_token(i))) for i in first.encode(whole, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text or ""):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    good = text and all(b"".join(x for _, x in side) == whole.encode() for side in (a, b))
    return (a, b) if good else ([], [])


def plain_document(a, b):
    """Links and groups, byte by byte."""
    owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
    links = sorted(set(zip(*owner)))
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
    groups, begin = [], 0
    for cut in sorted(ends[0] & ends[1]):
        ids = [",".join(str(side[k][0]) for k in dict.fromkeys(own[begin:cut])) for side, own in zip((a, b), owner)]
        groups.append("|".join(ids))
        begin = cut
    return [(a[i][0], b[j][0]) for i, j in links], groups


def plain(both, rows):
    docs = [(d, *(tokens := plain_tokens(both, t)), *plain_document(*tokens)) for d, t in rows]
    count = Counter(pair for *_, links, _ in docs for pair in links)
    best = Counter()
    for (_, j), k in count.items():
        best[j] = max(best[j], k)
    out = []
    for d, a, b, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", *alignment.COUNTED, "groups_sha256").collect()], key=str)


def test_merge_in_pieces():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 40)
        a, b = (np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randrange(1, n + 1))})) for _ in range(2))
        want = {(int(np.searchsorted(a, e)), int(np.searchsorted(b, e))) for e in range(1, n + 1)}
        for piece in (1, 2, 7, 1000):
            i, j, cuts = alignment.overlaps(a, b, piece)
            assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
            assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    splits = alignment.merge_path(np.arange(0, 100, 2), np.arange(1, 100, 2), np.arange(0, 101, 10))
    assert splits.tolist() == list(range(0, 51, 5))


TEXTS = [
    None, "", " ", "a", "two  spaces and \n\n lines\t.", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ lower block", "  wide", "İstanbul naïve façade",
    "中文字符 と かな", "👩‍🚀 emoji", "x" * 3000, "word " * 3000, "\x00\x01 control", "é combined", "1234567890 12.5%", "don't we'll I'm", "﻿mark", "\r\nend \r",
]


def test_texts(spark, both, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, pairs string")
    want = plain(both, rows)
    assert found(alignment.alignment_counts(df, *PATHS, queries.tokenizer_pattern())) == want
    assert alignment.alignment_counts(df.limit(0), *PATHS, queries.tokenizer_pattern()).count() == 0
    # The groups themselves, in rows and pieces of any size.
    texts = [t or "" for t in TEXTS]
    known = alignment.Tokenizers(*PATHS, queries.tokenizer_pattern())
    row = alignment.Aligned(known, texts).groups()
    assert row == [alignment.Aligned(known, [t]).groups()[0] for t in texts]
    whole = alignment.overlaps
    monkeypatch.setattr(alignment, "overlaps", lambda a, b: whole(a, b, 5))
    assert alignment.Aligned(known, texts).groups() == row
    groups = {r.n: r.groups for r in alignment.aligned_groups(df.selectExpr("text", "doc_id AS n"), ["n"], *PATHS, queries.tokenizer_pattern()).collect()}
    assert groups[4] == ";".join(plain_document(*plain_tokens(both, TEXTS[4]))[1])


def test_small_blocks(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    monkeypatch.setattr(alignment, "ROW_BYTES", 100)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "river", "Straße", "zu", "x1"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert found(alignment.alignment_counts(df, *PATHS, queries.tokenizer_pattern())) == plain(both, rows)


def test_query_on_given_documents(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert found(queries.op11_tokenizer_alignment(spark, sf)) == plain(both, rows)
