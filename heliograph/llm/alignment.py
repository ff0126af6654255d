"""Alignment of two tokenizers over the same texts, by merging the ends of their tokens.

Tokens of both cover a text's bytes, so both are increasing lists of byte offsets, and merging the lists
gives everything: each step is one pair of tokens that overlap, each offset in both lists cuts a group. The texts
of a batch stand in one row, whose merge is divided along the merge path: binary searches on evenly
spaced diagonals, all at once, tell how many ends of either list come before, so that pieces are of equal
work whatever the texts' lengths. Pieces emit their overlaps by themselves; the groups that go over a
boundary are stitched by adding up the cuts of earlier pieces.

Counts of id pairs are of the whole corpus. Tasks write documents in blocks of a bounded number of overlaps, each
with a dictionary of its pairs; the pairs of the blocks are counted, and what they count everywhere comes back
block by block. No document is broken up into rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import Scratch, in_small_batches, worker_state

#: Ends of either list per piece of the merge.
PIECE = 1 << 14
#: Bytes of text in a row, about, and overlaps of a block, about; a longer document is one by itself.
ROW_BYTES, BLOCK_LINKS = 1 << 20, 1 << 23

COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many elements of sorted `a` are among the first d of both in order, for every d of `diagonals`;
    of equal ones that of `a` comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] belongs to the first d if it isn't above the element of b at the other end.
        first = np.zeros(len(low), bool)
        at = np.flatnonzero(open_)
        first[at] = a[middle[at]] <= b[diagonals[at] - 1 - middle[at]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low


def _piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece, as indices into both lists, and the ends that both have."""
    own_a, own_b = a[i[0] : i[1]], b[j[0] : j[1]]
    over = j[0] + np.searchsorted(own_b, own_a)
    before = np.searchsorted(own_a, own_b)
    # An end of b that a has, too, comes right after it: in this piece, or as the first after another one.
    last = a[i[0] - 1] if i[0] else -1
    same = np.where(before < len(own_a), np.append(own_a, -1)[before], -1) == own_b
    if len(own_b) and own_b[0] == last:
        same[0] = True
    ai = np.concatenate([np.arange(*i), i[0] + before[~same]])
    bj = np.concatenate([over, np.arange(*j)[~same]])
    return ai, bj, own_b[same]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of the tokens that overlap, and the ends of groups, of two lists of token ends that have
    the last one in common."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    splits = merge_path(a, b, diagonals)
    parts = [_piece(a, b, i, j) for i, j in zip(zip(splits.tolist(), splits[1:].tolist()), zip((diagonals - splits).tolist(), (diagonals - splits)[1:].tolist()))]
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


class Tokenizers:
    """Both tokenizers, with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"] if t["special"]}
        # Byte-level entries: printable characters stand for themselves, the other bytes for 256 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if i not in special}
        # Merges come in the order of their ids, so that ranks are all that the merging needs.
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(e) for e in entries]) for entries in (self.a_bytes, self.b_bytes))
        # Ids as text, with what follows them.
        self.a_text = {mark: np.array([f"{i}{mark}" for i in range(len(self.a_bytes))], object) for mark in ",|"}
        self.b_text = {mark: np.array([f"{i}{mark}" for i in range(len(self.b_bytes))], object) for mark in ",;"}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text, none where the bytes of either aren't those of a space and the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else []):
            whole = " " + text
            a = self.a.encode_ordinary(whole)
            raw = whole.encode()
            good = text and b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((np.array(a if good else [], np.int64), np.array(b if good else [], np.int64)))
        return out


class Aligned:
    """Several texts in a row, tokenized and merged: per text `n` (a, b, groups, links) and its groups."""

    def __init__(self, known: Tokenizers, texts: list[str]) -> None:
        self.known, both = known, known.encode(texts)
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*both) if both else ((), ())))
        a_ends, b_ends = np.cumsum(known.a_sizes[self.a]), np.cumsum(known.b_sizes[self.b])
        ai, bj, cuts = overlaps(a_ends, b_ends)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (zip(*both) if both else ((), ())))
        doc = np.repeat(np.arange(len(both)), n_a)
        self.link_doc, self.link_a, self.link_b = doc[ai], self.a[ai], self.b[bj]
        # Which group each token is in, over the row.
        self.a_group, self.b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        first = np.cumsum(n_a)
        groups = np.diff(np.append(0, np.where(first > 0, np.append(self.a_group, -1)[first - 1] + 1, 0)))
        self.n = np.stack([n_a, n_b, groups, np.bincount(self.link_doc, minlength=len(both))], axis=1)

    def groups(self) -> list[str]:
        """Per text `a1,a2|b1;a3|b2,b3`."""
        a_last, b_last = (np.append(np.diff(g) != 0, True) if len(g) else np.empty(0, bool) for g in (self.a_group, self.b_group))
        place = np.empty(len(self.a) + len(self.b), object)
        # A group's tokens of a, then of b: before each come all of its side and those of the other side's groups.
        at = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group)
        place[at] = np.where(a_last, self.known.a_text["|"][self.a], self.known.a_text[","][self.a])
        at = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        place[at] = np.where(b_last, self.known.b_text[";"][self.b], self.known.b_text[","][self.b])
        parts, begin, out = place.tolist(), 0, []
        for n in (self.n[:, 0] + self.n[:, 1]).tolist():
            out.append("".join(parts[begin : begin + n])[:-1])
            begin += n
        return out


def _rows_of_texts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ROW_BYTES characters, with the place of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= ROW_BYTES or i == len(texts) - 1:
            yield begin, [t or "" for t in texts[begin : i + 1]]
            begin, size = i + 1, 0


def _known(a_path: str, b_path: str, pattern: str) -> Tokenizers:
    return worker_state(f"tokenizers {a_path} {b_path}", lambda: Tokenizers(a_path, b_path, pattern))


def _groups(a_path: str, b_path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(a_path, b_path, pattern)
        for batch in batches:
            for begin, texts in _rows_of_texts(batch.column(0).to_pylist()):
                row = Aligned(known, texts)
                kept = [c.slice(begin, len(texts)) for c in batch.columns[1:]]
                counts = [pa.array(c) for c in row.n.T]
                yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array(row.groups(), pa.string())], names=[*batch.schema.names[1:], *COUNTED[:4], "groups"])

    return run


def aligned_groups(docs: DataFrame, keys: list[str], a_path: str, b_path: str, pattern: str) -> DataFrame:
    """The columns `keys` of `docs`, the numbers of tokens, groups and links, and `groups`, the smallest
    stretches that both tokenizers cut, as text: `a1,a2|b1;a3|b2,b3`.

    Texts that are missing or empty, or that either tokenizer changes, have no tokens. Whole texts of any
    length count; repeated rows stay; an empty table gives an empty result; other columns aren't read.
    """
    rows = in_small_batches(docs.select(F.col("text").cast("string").alias("_text"), *keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    counts = ", ".join(f"{c} long" for c in COUNTED[:4])
    return rows.mapInArrow(_groups(a_path, b_path, pattern), f"{schema}, {counts}, groups string")


BLOCKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots binary, pairs array<long>, times array<int>"


def packed_slots(slots: np.ndarray, times: np.ndarray) -> bytes:
    """A document's pairs as increasing places in its block's dictionary, and how often it has each."""
    import zstandard

    steps = np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    many = np.asarray(times, "<u4").view(np.uint8).reshape(-1, 4)
    # Byte by byte, so that the high ones, nearly all zero, stand together.
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([steps, many], axis=1).T.tobytes())


def unpacked_slots(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<u4")
    return np.cumsum(both[:, 0].astype(np.int64)), both[:, 1].astype(np.int64)


def _blocks(a_path: str, b_path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = _known(a_path, b_path, pattern)
        block = TaskContext.get().partitionId() << 32
        schema = pa.schema([
            ("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTED[:4]), ("groups_sha256", pa.string()),
            ("slots", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
        ])
        held: list[dict] = []
        links = 0

        def close() -> pa.RecordBatch:
            """The block's documents, and the dictionary in a row of its own."""
            codes = np.concatenate([h["codes"] for h in held])
            pairs, place = np.unique(codes, return_inverse=True)
            times = np.bincount(place, np.concatenate([h["times"] for h in held]), len(pairs)).astype(np.int64)
            rows, begin = [], 0
            for h in held:
                own = place[begin : begin + len(h["codes"])]
                begin += len(own)
                cuts = h["cuts"]
                for d, (doc_id, n, sha) in enumerate(h["docs"]):
                    a, b = cuts[d], cuts[d + 1]
                    rows.append((block, doc_id, *n, sha, packed_slots(own[a:b], h["times"][a:b]), None, None))
            rows.append((block, *[None] * 7, pairs, times))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in _rows_of_texts(batch.column(1).to_pylist()):
                row = Aligned(known, texts)
                # Distinct pairs of each document, by document and pair.
                code = row.link_a << 20 | row.link_b
                keys, times = np.unique(row.link_doc << 40 | code, return_counts=True)
                shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in row.groups()]
                held.append({
                    "docs": list(zip(ids[begin : begin + len(texts)], row.n.tolist(), shas)), "codes": keys & ((1 << 40) - 1), "times": times,
                    "cuts": np.searchsorted(keys >> 40, np.arange(len(texts) + 1)).tolist(),
                })
                links += len(row.link_a)
                if links >= BLOCK_LINKS:
                    yield close()
                    held, links, block = [], 0, block + 1
        if held:
            yield close()

    return run


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block, from the counts of the block's dictionary."""
    order = np.argsort(counts.column("slot").to_numpy())
    count, best = (counts.column(c).to_numpy()[order] for c in ("count", "best"))
    n_best, sums = [], []
    for data in docs.column("slots").to_pylist():
        slots, times = unpacked_slots(data)
        sums.append(int((count[slots] * times).sum()))
        n_best.append(int(times[best[slots]].sum()))
    kept = docs.select(["doc_id", *COUNTED[:4], "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, the numbers of tokens, groups and links, `groups_sha256` of the text of `aligned_groups`
    (empty without tokens), `n_best` (links whose id pair is the most frequent one of its b id in the
    corpus, ties included) and `count_sum` (over the links, how often the corpus links their id pair).

    As in `aligned_groups`; texts without tokens give zeros. Rows without doc_id are counted like others.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    blocks = scratch.keep(rows.mapInArrow(_blocks(a_path, b_path, pattern), BLOCKED), "blocks")
    listed = blocks.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("slot", "p"))
    pairs = listed.select("block", "slot", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts = pairs.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)))
    counts = scratch.keep(counts, "counts")
    # One row per id of b, at most its vocabulary.
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = pairs.join(counts, "pair").select("block", "slot", "count", "best")
    left = blocks.filter("pairs IS NULL").select(F.col("block").alias("own_block"), "doc_id", *COUNTED[:4], "groups_sha256", "slots")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    # A block has a bounded number of overlaps, so both sides of a group are bounded.
    summed = left.groupBy("own_block").cogroup(known.groupBy("block")).applyInArrow(_summed, schema)
    return summed.select("doc_id", *COUNTED, "groups_sha256")
