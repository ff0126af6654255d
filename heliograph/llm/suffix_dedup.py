"""Repeated passages by a distributed, prefix-aware merge sort of suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id.

Not every suffix need be sorted. Each string of `LENGTH` bytes holds `WIDTH` short grams, and the one with
the smallest hash is its anchor; strings in a row mostly share their anchor, so that about one suffix in
twenty starts at one. Equal strings have equal anchors, so strings are only compared among suffixes whose
anchor gram is the same:

1. blocks of documents tell the shards of hash space which anchor grams they have (40 bits each);
2. a shard answers which of them occur in more than one document;
3. a block sorts its distinct suffixes at those anchors and sends each shard its run, front-coded: of a
   suffix only what differs from the one before (and compressed as a whole);
4. a shard merges the runs with a loser tree that knows the common prefix of every contender with the last
   winner. Contenders with different prefix lengths are ordered without looking at them, others are compared
   from there on. The merged order with its prefix lengths says which suffixes agree to the right of the
   anchor; together with what lies to its left, which strings are equal and which document has them first;
5. a block cuts what its shards found out of its documents.

A suffix that many documents of a block share is sent once, so a passage that is in a third of all documents
costs a shard one entry per block. Documents are shuffled once; the three steps that need them read the same
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 20
WIDTH = LENGTH - GRAM + 1
#: Bytes of text in a block, and anchors in a shard, about.
BLOCK_BYTES, SHARD_ANCHORS = 4 << 20, 1 << 19
#: Strings looked at together.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Anchors:
    """The runs of strings with one anchor in documents laid end to end: first and last string of each
    (`first`, `last`: where they start), the anchor's place, a hash of its gram, and a hash of the whole
    run, its extent included."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        up, down = _powers(BASE, CHUNK + LENGTH), _powers(pow(BASE, -1, 1 << 64), CHUNK + LENGTH)
        starts = np.append(0, ends[:-1])
        parts: list[tuple[np.ndarray, ...]] = []
        doc, at = 0, 0
        while doc < len(ends):
            # As many whole documents as fit, or a piece of a long one.
            begin = max(at, int(starts[doc]))
            if ends[doc] - begin > CHUNK:
                stop, until, at = begin + CHUNK, begin + CHUNK + LENGTH - 1, begin + CHUNK
                if until >= ends[doc]:
                    until = int(ends[doc])
                valid = np.ones(until - begin, bool)
                valid[max(0, until - begin - LENGTH + 1) :] = False
                valid[stop - begin :] = False
            else:
                last = max(doc + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
                until = int(ends[last - 1])
                valid = np.ones(until - begin, bool)
                for e in (ends[doc:last] - begin).tolist():
                    valid[max(0, e - LENGTH + 1) : e] = False
                for s, e in zip((starts[doc:last] - begin).tolist(), (ends[doc:last] - begin).tolist()):
                    if e - s < LENGTH:
                        valid[max(0, s) : e] = False
                doc = last
            if until - begin >= LENGTH:
                parts.append(self._runs(data[begin:until], valid, begin, up, down))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, t) for t in (np.int64,) * 3 + (U,) * 2]
        self.first, self.last, self.place, self.gram, self.run = columns
        self.data = data
        self.doc = np.searchsorted(ends, self.first, side="right")

    @staticmethod
    def _runs(data: np.ndarray, valid: np.ndarray, begin: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(data)
        sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # Least hash first, leftmost of equal ones.
        least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
        size = 1
        while 2 * size <= WIDTH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < WIDTH:
            least = np.minimum(least[: len(least) - (WIDTH - size)], least[WIDTH - size :])
        strings = np.flatnonzero(valid[: len(least)])
        if not len(strings):
            return tuple(np.empty(0, t) for t in (np.int64,) * 3 + (U,) * 2)
        place = (least[strings] & U(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(strings) != 1)) + 1
        first, last = strings[np.append(0, cuts)], strings[np.append(cuts, len(strings)) - 1]
        place = place[np.append(0, cuts)]
        whole = (sums[last + LENGTH] - sums[first]) * down[first]
        run = _mix(whole ^ _mix(((last - first) * 64 + place - first).astype(U)))
        # Anchors have small hashes; mixed once more they fill the shards evenly.
        return first + begin, last + begin, place + begin, _mix(grams[place] * U(0xD6E8FEB86659FD93)), run


class Block:
    """The documents of one block, smallest id first; those without id come last."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        texts = self.table.column("_data").combine_chunks()
        raw = [t or b"" for t in texts.to_pylist()]
        self.ends = np.cumsum([len(r) for r in raw]) if raw else np.empty(0, np.int64)
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.anchors = Anchors(self.data, self.ends)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor grams, sorted, and whether each is in several documents of the block."""
        order = np.argsort(self.anchors.gram, kind="stable")
        gram, ids = self.anchors.gram[order], self.ids[self.anchors.doc[order]]
        if not len(gram):
            return gram, np.empty(0, bool)
        starts = np.append(0, np.flatnonzero(np.diff(gram)) + 1)
        return gram[starts], np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)


def _cuts(gram: np.ndarray, bits: int) -> np.ndarray:
    """Where the shards begin in sorted grams: a shard is the topmost bits."""
    edges = (np.arange(1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(1, U)
    return np.append(np.searchsorted(gram, edges), len(gram))


GRAMS = "shard int, block int, grams binary, several binary"
FOUND = "block int, shard int, found binary"
RUNS = "shard int, block int, lengths binary, shared binary, tails binary, left_lengths binary, lefts binary, ids binary, runs binary"
GONE = "block int, runs binary, low binary, high binary"


def _table(columns: list[list], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.large_binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table([pa.array(c, kinds[k] if k == "int" else pa.binary()) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _tell(bits: int) -> Callable:
    def tell(key: tuple, table: pa.Table) -> pa.Table:
        gram, several = Block(table).grams()
        cuts = _cuts(gram, bits)
        rows: list[list] = [[] for _ in range(4)]
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[shard], cuts[shard + 1]
            # The shard is known; of the bits below it, the next 40 are enough for a first answer.
            small = ((gram[a:b] << U(bits)) >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            for row, value in zip(rows, (shard, key[0].as_py(), small.tobytes(), np.packbits(several[a:b]).tobytes())):
                row.append(value)
        return _table(rows, GRAMS)

    return tell


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Which grams of which block are in more than one document, by the 40 bits told."""
    blocks, parts, flags = table.column("block").to_pylist(), [], []
    for grams, several in zip(table.column("grams").to_pylist(), table.column("several").to_pylist()):
        five = np.frombuffer(grams, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        parts.append(wide.view("<u8").ravel())
        flags.append(np.unpackbits(np.frombuffer(several, np.uint8), count=len(five)).astype(bool))
    gram, found = np.concatenate(parts), np.concatenate(flags)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(found[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]
    return _table([blocks, [key[0].as_py()] * len(blocks), bits], FOUND)


def _rows(data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Bytes from each place on, in rows filled up with zeros."""
    columns, out = np.arange(width)[None, :], np.zeros((len(at), width), np.uint8)
    for a in range(0, len(at), 16384):  # places take eight times the room of bytes
        some = slice(a, a + 16384)
        places = np.minimum(at[some, None] + columns, len(data) - 1)
        out[some] = np.where(columns < length[some, None], data[places], 0)
    return out


def _shared(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    equal = rows[1:] == rows[:-1]
    n = np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))
    return np.append(0, np.minimum(n, np.minimum(length[1:], length[:-1])))


def _send(bits: int) -> Callable:
    def send(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        packed = lambda values: packer.compress(values.tobytes())
        rows: list[list] = [[] for _ in range(9)]
        if not docs.num_rows:
            return _table(rows, RUNS)
        block = Block(docs)
        own = block.anchors
        gram, _ = block.grams()
        cuts, wanted = _cuts(gram, bits), np.zeros(len(gram), bool)
        for shard, found in zip(answers.column("shard").to_pylist(), answers.column("found").to_pylist()):
            a, b = cuts[shard], cuts[shard + 1]
            wanted[a:b] = np.unpackbits(np.frombuffer(found, np.uint8), count=b - a)
        chosen = np.flatnonzero(wanted[np.searchsorted(gram, own.gram)]) if len(gram) else np.empty(0, np.int64)
        # Documents are in order of their ids, so the first of equal runs has the smallest.
        _, firsts = np.unique(own.run[chosen], return_index=True)
        chosen = chosen[firsts]
        length, left = own.last[chosen] + LENGTH - own.place[chosen], own.place[chosen] - own.first[chosen]
        suffix = _rows(block.data, own.place[chosen], length, LENGTH)
        shard_of = (own.gram[chosen] >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(chosen), np.int64)
        # By shard, then by the suffix, eight bytes at a time, then by its length.
        words = np.ascontiguousarray(np.pad(suffix, ((0, 0), (0, -LENGTH % 8)))).view(">u8").astype(U)
        order = np.lexsort((length, *words.T[::-1], shard_of))
        del words
        edges = np.searchsorted(shard_of[order], np.arange((1 << bits) + 1))
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            some = order[edges[shard] : edges[shard + 1]]
            own_rows, n = suffix[some], length[some]
            same = _shared(own_rows, n)
            columns = np.arange(LENGTH)[None, :]
            tails = own_rows[(columns >= same[:, None]) & (columns < n[:, None])]
            # To the left of the anchor, nearest byte first.
            back = np.arange(WIDTH - 1)[None, :]
            near = block.data[np.maximum(own.place[chosen[some]][:, None] - 1 - back, 0)]
            lefts = near[back < left[some][:, None]]
            ids = block.ids[own.doc[chosen[some]]]
            for row, value in zip(rows, (
                shard, key[0].as_py(), *map(packed, (
                    n.astype(np.uint8), same.astype(np.uint8), tails, left[some].astype(np.uint8), lefts, ids.astype("<i8"),
                )), own.run[chosen[some]].astype("<u8").tobytes(),
            )):
                row.append(value)
        return _table(rows, RUNS)

    return send


def decode_run(lengths: bytes, shared: bytes, tails: bytes) -> Iterator[bytes]:
    """The suffixes of a front-coded run."""
    before, at = b"", 0
    for n, same in zip(lengths, shared):
        before = before[:same] + tails[at : at + n - same]
        at += n - same
        yield before


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share `known` bytes."""
    n, i = min(len(a), len(b)), known
    while i + 8 <= n and a[i : i + 8] == b[i : i + 8]:
        i += 8
    while i < n and a[i] == b[i]:
        i += 1
    return i


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the string before) over all runs, in order.

    A tree of losers. With each contender goes the length of its common prefix with the last winner:
    the longer one is smaller, and only equal ones are compared, from that length on.
    """
    count = 1
    while count < len(runs):
        count *= 2
    heads = [0] * len(runs)
    prefix = [0] * len(runs)
    losers = [-1] * count

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps its prefix with the winner."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        x, y = runs[a][heads[a]], runs[b][heads[b]]
        n = _common(x, y, prefix[a])
        if n == len(x) or n == len(y):
            first = (len(x), a) < (len(y), b)
        else:
            first = x[n] < y[n]
        if not first:
            a, b = b, a
        prefix[b] = n
        return a, b

    level = [r if r < len(runs) and runs[r] else -1 for r in range(count)]
    node = count
    while len(level) > 1:
        node //= 2
        pairs = [play(level[2 * i], level[2 * i + 1]) for i in range(len(level) // 2)]
        for i, (_, loser) in enumerate(pairs):
            losers[node + i] = loser
        level = [winner for winner, _ in pairs]
    winner = level[0]
    while winner >= 0:
        yield winner, heads[winner], prefix[winner]
        run = winner
        heads[run] += 1
        if heads[run] < len(runs[run]):
            prefix[run] = shared[run][heads[run]]
        else:
            winner = -1
        node = (run + count) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def earlier_strings(length: np.ndarray, shared: np.ndarray, left: np.ndarray, lefts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For merged suffixes, and each distance of a string's start to the left of the anchor, whether an
    entry with a smaller id has that string. `lefts`: bytes to the left, nearest first."""
    out = np.zeros((len(ids), WIDTH), bool)
    group = np.cumsum(shared < GRAM)
    several = np.bincount(group)[group] > 1
    hashed = np.zeros(len(ids), U)
    for p in range(WIDTH):
        if p:
            hashed = _mix(hashed * U(BASE) + lefts[:, p - 1].astype(U) + U(1))
        own = np.flatnonzero(several & (left >= p) & (length >= LENGTH - p))
        if not len(own):
            continue
        right = np.cumsum(shared < LENGTH - p)[own].astype(U)
        key = _mix(hashed[own] + right * U(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        starts = np.append(0, np.flatnonzero(np.diff(key[order])) + 1)
        least = np.minimum.reduceat(ids[own][order], starts)
        sizes = np.diff(np.append(starts, len(order)))
        out[own[order], p] = np.repeat(least, sizes) < ids[own][order]
    return out


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    import zstandard

    rows = {c: table.column(c).to_pylist() for c in table.column_names}
    unpacker = zstandard.ZstdDecompressor()
    for c in ("lengths", "shared", "tails", "left_lengths", "lefts", "ids"):
        rows[c] = [unpacker.decompress(x) for x in rows[c]]
    runs = [list(decode_run(*r)) for r in zip(rows["lengths"], rows["shared"], rows["tails"])]
    offsets = np.append(0, np.cumsum([len(r) for r in runs]))
    merged = np.array([(offsets[r] + i, n) for r, i, n in merge_runs(runs, rows["shared"])], dtype=np.int64).reshape(-1, 2)
    del runs
    order, shared = merged[:, 0], merged[:, 1]
    flat = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)[order]
    left_all = np.frombuffer(b"".join(rows["left_lengths"]), np.uint8).astype(np.int64)
    lefts = np.zeros((len(left_all), WIDTH - 1), np.uint8)
    lefts[np.arange(WIDTH - 1)[None, :] < left_all[:, None]] = np.frombuffer(b"".join(rows["lefts"]), np.uint8)
    gone = earlier_strings(flat("lengths", np.uint8).astype(np.int64), shared, left_all[order], lefts[order], flat("ids", "<i8"))
    # Distances in a row become one piece.
    edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    entry, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    block = np.repeat(np.array(rows["block"]), np.diff(offsets))[order][entry]
    by = np.argsort(block, kind="stable")
    run = flat("runs", "<u8")[entry][by]
    cuts = np.flatnonzero(np.diff(block[by])) + 1
    parts = [np.split(c, cuts) for c in (block[by], run, low[by].astype(np.uint8), high[by].astype(np.uint8))]
    full = [k for k, b in enumerate(parts[0]) if len(b)]
    return _table([[int(parts[0][k][0]) for k in full], *([p[k].tobytes() for k in full] for p in parts[1:])], GONE)


def _cut(names: list[str], carried: list[str], as_text: bool) -> Callable:
    def cut(key: tuple, docs: pa.Table, gone: pa.Table) -> pa.Table:
        block = Block(docs)
        own, ids = block.anchors, block.ids
        marks = np.zeros(len(block.data) + 1, np.int64)

        def remove(first: np.ndarray, last: np.ndarray) -> None:
            np.add.at(marks, first, 1)
            np.add.at(marks, last + LENGTH, -1)

        # A run that a smaller id has in this very block goes whole, of others what the shards found.
        _, firsts, same = np.unique(own.run, return_index=True, return_inverse=True)
        copies = ids[own.doc] > ids[own.doc[firsts]][same] if len(same) else np.empty(0, bool)
        remove(own.first[copies], own.last[copies])
        joined = [b"".join(gone.column(c).to_pylist()) for c in ("runs", "low", "high")]
        runs, low, high = (np.frombuffer(j, k) for j, k in zip(joined, ("<u8", np.uint8, np.uint8)))
        order = np.argsort(own.run, kind="stable")
        a, b = (np.searchsorted(own.run[order], runs, side=s) for s in ("left", "right"))
        which = np.repeat(np.arange(len(runs)), b - a)
        hit = order[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        remove(own.place[hit] - high[which], own.place[hit] - low[which])
        covered = np.cumsum(marks[:-1]) > 0
        spans, kept, removed = [], [], []
        for start, end in zip(np.append(0, block.ends[:-1]).tolist(), block.ends.tolist()):
            mine = covered[start:end]
            edges = np.flatnonzero(np.diff(np.pad(mine.astype(np.int8), 1))).reshape(-1, 2).tolist()
            spans.append([{"start": x, "end": y} for x, y in edges])
            removed.append(int(mine.sum()))
            left = block.data[start:end][~mine].tobytes()
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        sizes = np.diff(np.append(0, block.ends))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [block.table.column(c).combine_chunks() for c in carried]
        columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())]
        return pa.table(columns, names=names)

    return cut


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, as_text: bool = False, block_bytes: int = BLOCK_BYTES, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """The columns `carry` (all but `text`, if not given) of every document, with `n_bytes`, `n_removed`,
    `spans` (start and end of each removed run, in bytes) and `kept`, the remaining bytes; `as_text` gives
    them as text, without what is left of characters that were cut into.

    Texts are UTF-8 bytes, taken whole at any length; a missing or empty one has none. Strings are judged on
    the input, not on what is left; matches don't cross documents. Rows with equal ids take nothing from each
    other; rows without id count as larger than all others, and equal among themselves. An empty table
    gives an empty result. Columns named like a result, or starting with an underscore, can't be carried.
    """
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length(data))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, (size // 20 // shard_anchors).bit_length())
    last = F.lit(2**63 - 1)
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("_block"),
        F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), data.alias("_data"), *carry,
    )
    by_block = dealt.groupBy("_block")
    told = by_block.applyInArrow(_tell(bits), GRAMS)
    found = told.groupBy("shard").applyInArrow(_answer, FOUND)
    sent = by_block.cogroup(found.groupBy("block")).applyInArrow(_send(bits), RUNS)
    gone = sent.groupBy("shard").applyInArrow(_merge, GONE)
    extra = "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary")
    schema = docs.select(*carry).schema
    for field in docs.sparkSession.createDataFrame([], extra).schema:
        schema = schema.add(field)
    return by_block.cogroup(gone.groupBy("block")).applyInArrow(_cut(schema.names, carry, as_text), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with their repeated passages cut out, in the columns of `docs`. `n_chars`, where there is
    one, is counted anew."""
    named = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    carried = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in named.items()])
    cut = remove_repeats(carried, list(named.values()), as_text=True)
    out = cut.select(*[F.col("kept").alias(c) if c == "text" else F.col(named[c]).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
