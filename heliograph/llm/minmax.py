"""Near duplicates by min-max hashing: the least and the greatest value of a shingle set under each permutation.

Both tell for an equal share of the sets whether they agree, so one permutation gives two values of a
signature and half as many are evaluated. Values are cut into bands of six, three permutations each; sets of
similarity 0.85 agree on a given band with probability 0.38 and miss all 32 with less than 3 in ten million. Texts with
equal sets are one class from the start. The classes of a band are compared to one leader per band first, so
that a large group costs one pair per member. What isn't connected by then is compared where its rarer shingles,
their places and the sizes leave room for the similarity. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import Scratch, in_small_batches, leaving_nothing, may_be_member, member_bits, text_key
from heliograph.llm.components import components

SHINGLE = 5
#: Similarity from which sets are linked, in hundredths.
LEAST = 85
#: Bands, and permutations of each; a permutation gives two values. A caller may ask for up to MOST_BANDS.
BANDS, DEPTH, MOST_BANDS = 32, 3, 64
#: Rounds with one leader per band.
STARS = 2
#: Numbers of classes from which a shingle counts as less rare.
RARITY = (2, 8, 64, 512)
#: Bits, at most, of each array that tells them: four of these pass through the driver.
RARITY_BITS = 1 << 24
#: Bits, at most, of the filter of bands that several classes have.
MOST_BITS = 1 << 27
#: Bytes of text, about, whose shingles stand in memory at once.
SLICE_BYTES = 1 << 20


def _constants(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, dtype=np.uint64)


#: x -> x * FACTOR + OFFSET permutes the numbers of 64 bits, as the factors are odd.
FACTORS, OFFSETS = _constants(MOST_BANDS * DEPTH, 11) | np.uint64(1), _constants(MOST_BANDS * DEPTH, 12)


def folded(values: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash of 64 bits per row over columns of numbers."""
    key = np.full(len(values[0]), seed, np.uint64)
    for v in values:
        key = key * np.uint64(0x9E3779B97F4A7C15) + v
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        key ^= key >> np.uint64(33)
    return key


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; fewer words are one shingle, none give none.

    Bytes are split at ASCII white space and only A-Z are lower-cased.
    """
    import xxhash

    split = [(t or "").encode().lower().split() for t in texts]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in numbers), np.uint64, len(numbers))[ids]
    # A window of the batch may reach over the end of its text; those are not taken.
    count = max(0, len(hashes) - SHINGLE + 1)
    windows = folded([hashes[k : k + count] for k in range(SHINGLE)], SHINGLE)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= SHINGLE:
            out.append(np.unique(windows[at : at + n - SHINGLE + 1]))
        else:
            out.append(folded([hashes[at + k : at + k + 1] for k in range(n)], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def band_keys(sets: list[np.ndarray], bands: int = BANDS) -> np.ndarray:
    """A row of band keys for each set, none of them empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        values = []
        for k in range(band * DEPTH, (band + 1) * DEPTH):
            moved = flat * FACTORS[k] + OFFSETS[k]
            values += [np.minimum.reduceat(moved, starts), np.maximum.reduceat(moved, starts)]
        keys[:, band] = folded(values, band + 1)
    return keys


def _signature(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _signed_lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into stretches of rows with about SLICE_BYTES of text, one row at least: words and shingles take
    many times the room of their text."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            yield batch.slice(a, b - a)


def _banded(bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 2):
            sets = shingle_sets(batch.column(2).to_pylist())
            full = [s for s in sets if len(s)]
            rows = iter(band_keys(full, bands) if full else [])
            keys = [next(rows) if len(s) else s for s in sets]
            columns = [batch.column(0), batch.column(1), _signed([_signature(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), _signed_lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "sig", "n", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, 1):
        sets = shingle_sets(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), _signed([_signature(s) for s in sets]), _signed_lists(sets)], names=["row", "sig", "hashes"])


def _other(key: str, name: str) -> Column:
    """A join key made anew from a column: both inputs of the join are then plain shuffles, whose skewed
    partitions Spark can split."""
    return F.bitwise_not(F.col(key)).alias(name)


def _sizes_fit(a: str, b: str, least: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * least


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Of pairs (u, v) of classes those whose whole sets are similar enough."""
    left = sets.select(_other("sig", "_u"), F.col("hashes").alias("x"))
    right = sets.select(_other("sig", "_v"), F.col("hashes").alias("y"))
    both = pairs.withColumn("_u", _other("u", "_u")).join(left, "_u").withColumn("_v", _other("v", "_v")).join(right, "_v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * (100 + least) >= (F.size("x") + F.size("y")) * least).select("u", "v")


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Bands whose classes aren't all connected, with the roots of their classes."""
    named = roots.select(_other("node", "_sig"), "root")
    rows = shared.withColumn("_sig", _other("sig", "_sig")).join(named, "_sig", "left").drop("_sig")
    rows = rows.withColumn("root", F.coalesce("root", "sig"))
    several = rows.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    return rows.withColumn("_band", _other("band", "_band")).join(several.select(_other("band", "_band")), "_band", "left_semi").drop("_band")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _popularity(shared: DataFrame) -> DataFrame:
    """How many other classes each one meets in its bands. What a group of near copies was made from is nearer to
    all of them than they are to each other, and so meets most."""
    sizes = shared.groupBy("band").agg(F.count(F.lit(1)).alias("k")).select(_other("band", "_band"), "k")
    met = shared.withColumn("_band", _other("band", "_band")).join(sizes, "_band")
    return met.groupBy("sig").agg(F.sum("k").alias("met")).select(_other("sig", "_sig"), "met")


def _led(left: DataFrame, popularity: DataFrame, turn: int, least: int) -> DataFrame:
    """Pairs of the classes of a band with its leader: the most popular one at first, then any other."""
    if turn:
        rank = F.struct(F.xxhash64("sig", F.lit(turn)))
    else:
        rank = F.struct("met", "sig")
        left = left.withColumn("_sig", _other("sig", "_sig")).join(popularity, "_sig").drop("_sig")
    other = left.groupBy("band").agg(F.max_by(F.struct("sig", "n", "root"), rank).alias("o"))
    other = other.select(_other("band", "_band"), *(F.col(f"o.{c}").alias(f"o_{c}") for c in ("sig", "n", "root")))
    pairs = left.withColumn("_band", _other("band", "_band")).join(other, "_band").filter("root <> o_root").filter(_sizes_fit("n", "o_n", least))
    return _ordered(pairs.select(F.col("sig").alias("u"), F.col("o_sig").alias("v")))


def _by_prefix(left: DataFrame, sets: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Pairs of classes of different roots that may still be similar, none of them left out.

    Shingles stand in the order of their rarity among these classes, in steps, and then of their hashes. Similar
    sets share a shingle before both run out of room for enough shared ones behind it. A copy's own changes come
    first and use up its room, so copies of one text that aren't similar to it give no pairs under
    its shingles, however many they are. Rarity is told by bit arrays: a shingle that is taken for a more
    frequent one is so for all sets, which costs pairs but loses none.
    """
    open_ = left.select(_other("sig", "_sig"), "root").distinct()
    open_ = scratch.keep(sets.withColumn("_sig", _other("sig", "_sig")).join(open_, "_sig").select("sig", "root", "hashes"), "open")
    common = open_.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    common = scratch.keep(common, "common")
    level = F.lit(0)
    for least_k in RARITY:
        these = common.filter(F.col("k") >= least_k)
        size = min(RARITY_BITS, max(1 << 20, 64 << these.count().bit_length()))
        level = level + may_be_member(F.col("h"), member_bits(these, "h", size), size).cast("int")
    tokens = open_.select("sig", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("h")).select("*", level.alias("level")).filter("level > 0")
    split = tokens.groupBy("sig", "root", "n").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("often"))
    alone, room = F.col("n") - F.size("often"), F.col("n") - F.ceil(F.col("n") * least / 100)
    first = F.slice("often", F.lit(1), F.greatest(F.lit(0), room - alone + 1).cast("int"))
    rows = split.select("sig", "root", "n", alone.alias("alone"), F.posexplode(first).alias("k", "t")).withColumn("h", F.col("t.h"))
    rows = scratch.keep(rows.select("sig", "root", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("rest"), "h"), "prefixes")
    several = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(_other("h", "_h"))
    rows = rows.withColumn("_h", _other("h", "_h")).join(several, "_h", "left_semi").drop("_h")
    other = rows.select(_other("h", "_h"), *(F.col(c).alias(f"o_{c}") for c in ("sig", "root", "n", "rest")))
    enough = F.least("rest", "o_rest") * (100 + least) >= (F.col("n") + F.col("o_n")) * least
    pairs = rows.join(other, (_other("h", "_own") == F.col("_h")) & (F.col("root") < F.col("o_root")) & enough)
    return _ordered(pairs.select(F.col("sig").alias("u"), F.col("o_sig").alias("v")))


def _linked(shared: DataFrame, sets: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the classes connected by links, except the roots themselves.

    Only row counts come to the driver.
    """
    spark = shared.sparkSession
    # Not made of an empty list: its rows would come from Python workers, which stay in the executors' memory.
    nothing = spark.range(0)
    links = tried = nothing.select(F.col("id").alias("u"), F.col("id").alias("v"))
    roots = nothing.select(F.col("id").alias("node"), F.col("id").alias("root"))
    popularity = scratch.keep(_popularity(shared), "popularity")
    for turn in range(STARS + 1):
        left = scratch.keep(_apart(shared, roots), f"apart-{turn}")
        if left.isEmpty():
            break
        pairs = _led(left, popularity, turn, least) if turn < STARS else _by_prefix(left, sets, least, scratch)
        pairs = scratch.keep(pairs.join(tried, ["u", "v"], "left_anti"), f"pairs-{turn}")
        tried = tried.unionByName(pairs)
        found = scratch.keep(_confirmed(pairs, sets, least), f"links-{turn}")
        scratch.drop(f"apart-{turn}", "open", "common", "prefixes")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links, "minmax-parts")
    return roots


def row_key(docs: DataFrame) -> Column:
    """A hash of a document's id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), text_key(docs["text"].cast("string")))


def linked_groups(docs: DataFrame, least: int = LEAST, bands: int = BANDS) -> DataFrame:
    """doc_id, `row` (see `row_key`), `n` (the number of shingles), `root` (the same for all rows of a group) and
    `component_id` (the group's smallest doc_id).

    Texts without words are one group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text")))
    records = scratch.keep(rows.mapInArrow(leaving_nothing(_banded(bands)), "doc_id long, row long, sig long, n long, bands array<long>"), "records")
    # A row of each class stands for it.
    first = [F.min("row").alias("row"), F.min("doc_id").alias("least"), F.max("n").alias("n")]
    classes = scratch.keep(records.groupBy("sig").agg(*first), "classes")
    spread = records.filter("n > 0").select(F.explode("bands").alias("band"), "sig", "n")
    several = spread.groupBy("band").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b")
    several = scratch.keep(several.select(_other("band", "_band")), "several")
    # Most bands belong to one class: they are left out before the join, so that they need not be shuffled.
    size = min(MOST_BITS, max(1 << 20, 8 << several.count().bit_length()))
    likely = spread.withColumn("_band", _other("band", "_band")).filter(may_be_member(F.col("_band"), member_bits(several, "_band", size), size))
    shared = scratch.keep(likely.join(several, "_band", "left_semi").drop("_band").distinct(), "shared")
    # The sets of these classes, each from one text.
    wanted = shared.select(_other("sig", "_sig")).distinct()
    wanted = scratch.keep(classes.withColumn("_sig", _other("sig", "_sig")).join(wanted, "_sig", "left_semi").select("row"), "wanted")
    size = min(MOST_BITS, max(1 << 20, 8 << wanted.count().bit_length()))
    texts = rows.filter(may_be_member(F.col("row"), member_bits(wanted, "row", size), size)).select("row", "text")
    found = in_small_batches(texts).mapInArrow(leaving_nothing(_sets), "row long, sig long, hashes array<long>")
    sets = scratch.keep(found.join(wanted, "row", "left_semi").dropDuplicates(["row"]).select("sig", "hashes"), "sets")
    roots = scratch.keep(_linked(shared, sets, least, scratch), "parts")
    scratch.drop("several", "shared", "wanted", "sets")
    named = classes.join(roots, classes.sig == roots.node, "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = scratch.keep(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).select(_other("root", "_root"), "component_id")
    named = named.withColumn("_root", _other("root", "_root")).join(smallest, "_root").select(_other("sig", "_sig"), "root", "component_id")
    return records.select("doc_id", "row", "n", _other("sig", "_sig")).join(named, "_sig").drop("_sig")


def minmax_groups(docs: DataFrame) -> DataFrame:
    """doc_id, `n_shingles` (the size of the text's set of distinct 5-word shingles), `component_id` (the
    smallest doc_id reachable over links) and `kept` (whether that is the row's own id).

    Sets link when they share 85 hundredths of their union or more. Texts without words (missing, empty,
    blank) are linked with nothing; fewer than five words are one shingle; whole texts of any length count.
    Rows without doc_id get the component of the others, null if there are none, and aren't kept; repeated
    rows stay; an empty table gives an empty result; other columns of `docs` are not read.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
