"""Near duplicates by SimHash, with bit-sliced comparison of fingerprints.

Two 64-bit fingerprints that differ in at most `radius` bits agree on at least `kept` of
`radius + kept` blocks of bits. Distinct fingerprints are dealt out once for every choice of blocks,
so that every pair to be linked meets in some bucket. Inside a bucket fingerprints stand upright: plane
b holds bit b of 64 fingerprints per word. A query adds the planes into bitwise counters with carries,
which updates 64 distances per operation, and blocks in which every distance has passed the radius are
abandoned. A bucket gives the links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches, text_key, written
from heliograph.llm.components import components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Buckets above this size are divided again by further blocks of bits.
DIRECT = 4096
TILE = 512


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text's word shingles; 0 without words.

    Bytes are split at ASCII white space and only A-Z are lower-cased.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key("text").alias("text_hash"), F.col("text").cast("string"))
    return in_small_batches(rows).mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fp long")


def _beyond(planes: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits set where the counter, read across the planes, is above the radius."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(planes))):
        if radius >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return above


def close_pairs(prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints at most `radius` bits apart, a tile of queries at a time."""
    n = len(prints)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), dtype=np.uint8)
    bits[:n] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upright = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    unused = np.zeros(words, dtype=np.uint64)
    if n % 64:
        unused[-1] = FULL << np.uint64(n % 64)
    width = (radius + 1).bit_length()
    for begin in range(0, n, TILE):
        rows = np.arange(begin, min(n, begin + TILE))
        cols = np.arange(begin // 64, words)
        counters = [np.zeros((len(rows), len(cols)), dtype=np.uint64) for _ in range(width)]
        over = np.repeat(unused[None, cols], len(rows), axis=0)
        for b in range(BITS):
            query = np.where(bits[rows, b], FULL, np.uint64(0))
            carry = upright[b, cols][None, :] ^ query[:, None]
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                beyond = _beyond(counters, over, radius)
                live = beyond != FULL
                keep_rows, keep_cols = live.any(axis=1), live.any(axis=0)
                if not keep_rows.any():
                    rows = rows[:0]
                    break
                if not (keep_rows.all() and keep_cols.all()):
                    at = np.ix_(keep_rows, keep_cols)
                    counters, over = [c[at] for c in counters], over[at]
                    rows, cols, beyond = rows[keep_rows], cols[keep_cols], beyond[at]
        if len(rows):
            near = np.unpackbits(np.ascontiguousarray(~beyond).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            i, j = rows[i], cols[j // 64] * 64 + j % 64
            yield i[i < j], j[i < j]


def _settle(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge linked labels in place; a label is the smallest index of its part."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(prints: np.ndarray, free: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within `radius` among distinct fingerprints that agree on
    all bits but `free`. Large sets are divided by blocks of the free bits, one of which any pair to
    be linked agrees on."""
    if len(prints) < 2:
        return
    if len(prints) <= DIRECT or len(free) <= radius:
        labels = np.arange(len(prints))
        for i, j in close_pairs(prints, radius):
            _settle(labels, i, j)
        moved = np.flatnonzero(labels != np.arange(len(prints)))
        yield prints[moved], prints[labels[moved]]
        return
    for block in np.array_split(np.array(free), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in block))
        order = np.argsort(prints & mask, kind="stable")
        cuts = np.flatnonzero(np.diff((prints & mask)[order])) + 1
        rest = [b for b in free if b not in set(block.tolist())]
        for part in np.split(order, cuts):
            yield from forest(prints[part], rest, radius)


def block_choices(radius: int, kept: int) -> list[tuple[int, list[int]]]:
    """Every choice of `kept` of `radius + kept` blocks: the mask of its bits, and the other bits."""
    blocks = np.array_split(np.arange(BITS), radius + kept)
    out = []
    for choice in combinations(range(radius + kept), kept):
        held = {int(b) for k in choice for b in blocks[k]}
        out.append((sum(1 << b for b in held), [b for b in range(BITS) if b not in held]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_links(radius: int, kept: int) -> Callable:
    choices = block_choices(radius, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(fp))
            several = ends - starts > 1
            out = [(np.empty(0, np.uint64),) * 2]
            for a, b in zip(starts[several], ends[several]):
                out += forest(fp[a:b].view(np.uint64), choices[choice[a]][1], radius)
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(last):
                yield from links(*(h[: last[-1] + 1] for h in held))
                held = [h[last[-1] + 1 :] for h in held]
        yield from links(*held)

    return run


def linked_classes(prints: DataFrame, radius: int = 2, kept: int = 2) -> DataFrame:
    """(fp, root) for each distinct fingerprint: the same root for all that are connected by steps of
    at most `radius` differing bits."""
    distinct = prints.select("fp").distinct()
    keyed = distinct.select(
        "fp", F.explode(F.array(*[
            F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key"))
            for c, (mask, _) in enumerate(block_choices(radius, kept))
        ])).alias("b"),
    ).select("b.choice", "b.key", "fp")
    buckets = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    roots = components(buckets.mapInArrow(_bucket_links(radius, kept), "u long, v long"), "simhash-links")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, text_hash, `fp` and `component_id`, the smallest doc_id reachable over links.

    Fingerprints link when at most `radius` bits differ. Copies share a fingerprint and are one class
    from the start. Texts without words (missing, empty, blank) have fingerprint 0 and link like any
    other; fewer words than a shingle are one shingle; whole texts of any length count. Rows without
    doc_id get the component of the others, null if there are none; repeated rows stay; an empty table
    gives an empty result; other columns of `docs` are not read.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = written(classes.join(linked_classes(prints, radius), "fp"), "simhash-classes")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    smallest = smallest.select(F.bitwise_not("root").alias("_root"), "component_id")
    named = rooted.withColumn("_root", F.bitwise_not("root")).join(smallest, "_root")
    named = named.select(F.bitwise_not("fp").alias("_fp"), "component_id")
    return prints.withColumn("_fp", F.bitwise_not("fp")).join(named, "_fp").drop("_fp")


def first_of_each_group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Documents without their near copies: of each group the one with the smallest doc_id.

    Repeated rows stay once. Documents without id stay where no document with an id is in their group,
    once per text. Columns are those of `docs`.
    """
    groups = simhash_groups(docs, shingle, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Of several texts with the group's smallest id, or without any, one per group stays.
    stay = groups.groupBy("doc_id", "fp").agg(F.min("text_hash").alias("hash"))
    stay = stay.select(_row_key(F.col("doc_id"), F.col("hash")).alias("_stays")).distinct()
    marked = docs.withColumn("_row", _row_key(F.col("doc_id").cast("long"), text_key("text")))
    # One key for the join and for repeated rows, so that texts are shuffled once.
    return marked.join(stay, F.col("_row") == F.col("_stays"), "left_semi").dropDuplicates(["_row"]).drop("_row")


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    """A document's id and text in one value."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), text_hash.cast("string"))
