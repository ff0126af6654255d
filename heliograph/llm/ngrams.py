"""Interpolated modified Kneser-Ney over characters, counted by Spark, looked up in sorted arrays and by joins.

Characters become symbols of 12 bits: letters, letters with accents by their base letter, digits, spaces,
line ends, common signs, capitals that follow a capital; every character of another alphabet has a symbol
of its own, as far as 4,032 symbols go, and shares it with one far away beyond. An n-gram of up to five
symbols is a number of 60 bits, which is its hash.

The tables of a model grow with the text that it is counted on, so they are never carried whole. The most
frequent entries of each order, at most `HEAD`, are broadcast as sorted arrays, with a bit array of the
others' keys. What a text needs beyond them, it hands on as (gram, count), and joins with the tables give
its share of the sum. The result is that of the whole model, whatever `HEAD` is.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches, written

ORDER = 5
BITS = 12
SIGNS = ".,;:!?'\"-()/|#*$%&<>"
ACCENTED = "aeioucn"
SPACE, LINE, DIGIT, OTHER_SIGN, OTHER_ACCENT, CAPITALS = 26, 27, 28, 29, 30, 31
FIRST_SIGN = 32
FIRST_ACCENT = FIRST_SIGN + len(SIGNS)
#: First symbol, and first code point, of other alphabets.
OTHERS, TABLED = 64, 0x250
#: Code points that are words of their own in texts without spaces.
IDEOGRAPHS = (0x2E80, 0xA000)
#: Entries of one order that are broadcast, and bits of the filter of the others: 16 each, up to 4 MB.
HEAD, MOST_BITS = 1 << 17, 1 << 25
#: Symbols counted or scored at a time, and sums held by a task that counts.
SLICE, SUMS = 4_000_000, 4_000_000
#: Symbols of a passage that counts as seen before in its text.
PASSAGE = 20
MIX = 0x9E3779B97F4A7C15


def _symbol(code: int) -> int:
    char = chr(code)
    if char == "\n":
        return LINE
    if char.isspace():
        return SPACE
    if char in SIGNS:
        return FIRST_SIGN + SIGNS.index(char)
    low = char.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - ord("a")
    if char.isdigit():
        return DIGIT
    if char.isalpha():
        base = unicodedata.normalize("NFD", low)[0]
        return FIRST_ACCENT + ACCENTED.index(base) if base in ACCENTED else OTHER_ACCENT
    return OTHER_SIGN


def symbol_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of the first code points, whether it is a capital, and which code points are letters."""
    symbols = np.array([_symbol(c) for c in range(TABLED)], dtype=np.uint16)
    capitals = np.array([chr(c).isupper() for c in range(TABLED)])
    return symbols, capitals, np.array([chr(c).isalpha() for c in range(1 << 16)])


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")


def symbols_of(text: str | None, tables: tuple) -> np.ndarray:
    """The symbols of a whole text, one per character."""
    codes = _codes(text)
    low = np.minimum(codes, TABLED - 1)
    out, capital = tables[0][low], tables[1][low]
    if len(codes) and codes.max() >= TABLED:
        other = OTHERS + (codes - np.uint32(TABLED)) % ((1 << BITS) - OTHERS)
        out = np.where(codes < TABLED, out, other).astype(np.uint16)
        capital = capital & (codes < TABLED)
    out[1:][capital[1:] & capital[:-1]] = CAPITALS
    return out


def words_in(text: str | None, tables: tuple) -> int:
    """Runs of letters of a whole text; each ideograph is a word."""
    codes = _codes(text)
    letters = tables[2]
    letter = letters[np.minimum(codes, len(letters) - 1)] & (codes < len(letters))
    alone = letter & (codes >= IDEOGRAPHS[0]) & (codes < IDEOGRAPHS[1])
    run = np.append(False, letter & ~alone)
    return int((run[1:] & ~run[:-1]).sum() + alone.sum())


def grams_of(symbols: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol; a text starts after line ends."""
    padded = np.concatenate([np.full(ORDER - 1, LINE, np.uint64), symbols.astype(np.uint64)])
    n = len(symbols)
    return reduce(lambda a, k: (a << np.uint64(BITS)) | padded[k : k + n], range(1, ORDER), padded[:n].copy())


def _sums(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(grams, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = symbol_table()
    held = np.empty(0, np.uint64), np.empty(0, np.int64)

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], names=["gram", "n"])

    def slices() -> Iterator[np.ndarray]:
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.append(grams_of(symbols_of(text, tables)))
                size += len(waiting[-1])
                if size > SLICE:
                    yield np.concatenate(waiting)
                    waiting, size = [], 0
        if size:
            yield np.concatenate(waiting)

    for part in slices():
        found, n = np.unique(part, return_counts=True)
        held = _sums(np.concatenate([held[0], found]), np.concatenate([held[1], n]))
        if len(held[0]) > SUMS:
            yield record()
            held = np.empty(0, np.uint64), np.empty(0, np.int64)
    yield record()


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over whole texts: the one column of `texts`. Each task sends its own sums."""
    return in_small_batches(texts).mapInArrow(_counter, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame) -> DataFrame:
    """Of one order's (gram, n): the discounted share of each gram, and the weight its context gives to
    the lower order. Discounts come from how many grams were counted once, twice, and so on."""
    of = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)}
    c = counts.agg(*of.values()).first()
    n1, n2, n3, n4 = (float(c[k] or 0) for k in range(4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    steps = [
        min(max(k - (k + 1) * y * after / own, 0.05), k) if own and after else 0.5 * k
        for k, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    ]
    discount = F.when(F.col("n") == 1, steps[0]).when(F.col("n") == 2, steps[1]).otherwise(steps[2])
    context = F.shiftright("gram", BITS)
    sums = counts.groupBy(context.alias("_context")).agg(F.sum("n").alias("_all"), F.sum(discount).alias("_off"))
    return counts.withColumn("_context", context).join(sums, "_context").select(
        "gram", "n", ((F.col("n") - discount) / F.col("_all")).alias("share"), (F.col("_off") / F.col("_all")).alias("rest"),
    )


def kneser_ney(counts: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> list[DataFrame]:
    """Per order from 1 up a written table (gram, n, p, rest): the count of every gram seen, its interpolated
    probability, and the weight that its context leaves to unseen ones.

    The highest order has counts of occurrences, lower ones have the number of different symbols found
    before a gram. Each order joins its shares to the lower order's probabilities by the shorter gram.
    """
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        tables.insert(0, tables[0].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    out: list[DataFrame] = []
    for order, table in enumerate(tables, 1):
        shares = _discounted(table)
        if order == 1:
            p = F.col("share") + F.col("rest") / (1 << BITS)
            out.append(keep(shares.select("gram", "n", p.alias("p"), "rest"), "ngrams-1"))
            continue
        lower = out[-1].select(F.col("gram").alias("_shorter"), F.col("p").alias("_lower"))
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))
        joined = shares.withColumn("_shorter", shorter).join(lower, "_shorter")
        p = F.col("share") + F.col("rest") * F.col("_lower")
        out.append(keep(joined.select("gram", "n", p.alias("p"), "rest"), f"ngrams-{order}"))
    return out


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """A bit of an array of `size` bits, a power of two, for each key."""
    return (keys * np.uint64(MIX)) >> np.uint64(64 - size.bit_length() + 1)


def _bit_words(sizes: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy().astype(np.uint64)
            for k in np.unique(part).tolist():
                slot = np.unique(_slots(key[part == k], sizes[k]))
                word, first = np.unique(slot >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                columns = [pa.array([k] * len(word), pa.int32()), pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "word", "bits"])

    return run


def _heads(entries: DataFrame, parts: int, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Of (part, key, n, log), for each part: sorted keys and logarithms of the most frequent entries, at most
    `most`, and a bit array of the other ones' keys, None if there are none."""
    level = F.floor(F.log2("n") * 8)
    counted = entries.groupBy("part", level.alias("level")).count().collect()
    cuts, sizes = {}, {}
    for k in range(parts):
        cuts[k], total, steps = 1000, 0, sorted(((r["level"], r["count"]) for r in counted if r["part"] == k), reverse=True)
        for step, count in steps:
            if total + count > most:
                break
            cuts[k], total = step, total + count
        members = sum(count for _, count in steps) - total
        if members:
            sizes[k] = min(max(1 << (16 * members).bit_length(), 1 << 10), MOST_BITS)
    cut = F.element_at(F.array(*[F.lit(cuts[k]) for k in range(parts)]), F.col("part") + 1)
    rows = entries.filter(level >= cut).select("part", "key", "log").toPandas().sort_values(["part", "key"])
    rest = entries.filter(level < cut).select("part", "key").mapInArrow(_bit_words(sizes), "part int, word int, bits long")
    words = rest.groupBy("part", "word").agg(F.bit_or("bits").alias("bits")).toPandas() if sizes else None
    heads = []
    for k in range(parts):
        own, bits = rows[rows["part"] == k], None
        if k in sizes:
            set_words = words[words["part"] == k]
            bits = np.zeros(sizes[k] // 64, np.uint64)
            bits[set_words["word"].to_numpy(np.int64)] = set_words["bits"].to_numpy(np.int64).view(np.uint64)
        heads.append((own["key"].to_numpy(np.uint64), own["log"].to_numpy(np.float64), bits))
    return heads


class Model:
    """A model's tables per order, with what is broadcast of them."""

    def __init__(self, counts: DataFrame, head: int = HEAD) -> None:
        """Of (gram, n)."""
        grams = kneser_ney(counts)
        context = F.shiftright("gram", BITS).alias("key")
        parts = [t.select(F.col("gram").alias("key"), "n", F.log("p").alias("log")) for t in grams]
        parts += [t.groupBy(context).agg(F.sum("n").alias("n"), F.log(F.max("rest")).alias("log")) for t in grams]
        numbered = [t.select(F.lit(k).alias("part"), "key", "n", "log") for k, t in enumerate(parts)]
        entries = written(reduce(DataFrame.unionAll, numbered), "ngram-entries")
        tables = [entries.filter(F.col("part") == k) for k in range(len(parts))]
        self.grams, self.contexts = tables[:ORDER], tables[ORDER:]
        heads = _heads(entries, len(parts), head)
        self.heads = [heads[:ORDER], heads[ORDER:]]

    def logs_of(self, grams: DataFrame) -> DataFrame:
        """(gram, log) for different grams, by joins: order by order, where the longer one wasn't counted."""
        out = grams.select("gram", F.lit(0.0).alias("log"), F.lit(True).alias("open"))
        for order in range(ORDER, 0, -1):
            own = F.col("gram").bitwiseAND(F.lit(_mask(order)))
            known = self.grams[order - 1].select(F.col("key").alias("_gram"), F.col("log").alias("_log"))
            rest = self.contexts[order - 1].select(F.col("key").alias("_context"), F.col("log").alias("_rest"))
            out = out.join(known, own == F.col("_gram"), "left").join(rest, F.shiftright(own, BITS) == F.col("_context"), "left")
            step = F.coalesce("_log", "_rest", F.lit(0.0))
            out = out.select(
                "gram", (F.col("log") + F.when(F.col("open"), step).otherwise(0.0)).alias("log"),
                (F.col("open") & F.col("_log").isNull()).alias("open"),
            )
        return out.select("gram", (F.col("log") + F.when(F.col("open"), -BITS * math.log(2)).otherwise(0.0)).alias("log"))


class Lookup:
    """What was broadcast of a model."""

    def __init__(self, heads: list) -> None:
        self.grams, self.contexts = heads

    def log_probabilities(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithm of each gram's last symbol after its others, backing off where unseen, and
        which grams need the tables."""
        out, unknown = np.zeros(len(grams)), np.zeros(len(grams), bool)
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            own = grams[left] & np.uint64(_mask(order))
            for (keys, logs, bits), final in ((self.grams[order - 1], True), (self.contexts[order - 1], False)):
                key = own if final else own >> np.uint64(BITS)
                at, found = _places(keys, key)
                out[left[found]] += logs[at[found]]
                stays = ~found if final else np.ones(len(left), bool)
                if bits is not None:
                    slot = _slots(key, len(bits) * 64)
                    may_be = ~found & ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1)
                    unknown[left[may_be]] = True
                    stays &= ~may_be
                left, own = left[stays], own[stays]
            if not len(left):
                break
        out[left] -= BITS * math.log(2)
        out[unknown] = 0.0
        return out, unknown


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands in a sorted array, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def repeated(symbols: np.ndarray, lengths: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """Which symbols end a passage that was in the same text before; texts are laid end to end."""

    def joined(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
        """Hashes of stretches, from those of their first parts and of their last `size` symbols."""
        out = second.copy()
        out[size:] ^= (first[: len(first) - size] + np.uint64(size)) * np.uint64(MIX)
        return (out ^ (out >> np.uint64(29))) * np.uint64(MIX)

    power = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    whole, done, size = None, 0, 1
    while size <= passage:
        if passage & size:
            whole = power if whole is None else joined(power, whole, done)
            done += size
        power = joined(power, power, size) if size * 2 <= passage else power
        size *= 2
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero(np.arange(len(symbols)) - starts >= passage - 1)
    again = np.zeros(len(symbols), bool)
    if len(ends):
        _, first = np.unique((whole ^ (owner * np.uint64(MIX)))[ends], return_index=True)
        again[ends] = True
        again[ends[first]] = False
    return again


def scores(texts: list[str | None], heads: list, tables: tuple, once: bool) -> Iterator[tuple[float, int, int, list[dict]]]:
    """Per whole text: negative log probability as far as it was broadcast, symbols, words, and the grams left
    with their counts. `once`: what ends a passage seen before in the text costs nothing."""
    lookup = Lookup(heads)

    def done(symbols: list[np.ndarray], words: list[int]) -> Iterator[tuple]:
        grams = np.concatenate([grams_of(s) for s in symbols])
        lengths = np.array([len(s) for s in symbols])
        logs, unknown = lookup.log_probabilities(grams)
        if once and len(grams):
            again = repeated(np.concatenate(symbols), lengths)
            logs[again], unknown[again] = 0.0, False
        ends = np.cumsum(lengths)
        sums = np.append(0.0, np.cumsum(logs))
        places = np.flatnonzero(unknown)
        cuts = np.searchsorted(places, np.append(0, ends))
        for k, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
            mine, counts = np.unique(grams[places[cuts[k] : cuts[k + 1]]], return_counts=True)
            rest = [{"gram": g, "n": c} for g, c in zip(mine.astype(np.int64).tolist(), counts.tolist())]
            yield float(sums[end - n] - sums[end]), n, words[k], rest

    symbols, words, size = [], [], 0
    for text in texts:
        symbols.append(symbols_of(text, tables))
        words.append(words_in(text, tables))
        size += len(symbols[-1])
        if size > 500_000:
            yield from done(symbols, words)
            symbols, words, size = [], [], 0
    if symbols:
        yield from done(symbols, words)


SCORED = "row long, log_sum double, symbols long, words long, rest array<struct<gram: long, n: long>>"
_REST = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))


def scored_columns(texts: list[str | None], heads: list, tables: tuple, once: bool, first_row: int) -> list[pa.Array]:
    """The columns of `SCORED`; rows are numbered from `first_row`."""
    found = list(zip(*scores(texts, heads, tables, once)))
    types = (pa.float64(), pa.int64(), pa.int64(), _REST)
    rows = pa.array(range(first_row, first_row + len(texts)), pa.int64())
    return [rows, *(pa.array(list(c), t) for c, t in zip(found, types))]


def task_rows() -> int:
    """The first row number of a task: its rows are numbered on from there."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 36


def with_mean(measured: DataFrame, model: Model) -> DataFrame:
    """Rows with the columns of `SCORED`, written before: their log perplexity per word as `mean_log`, with what
    the tables add; without `row`, `log_sum` and `rest`. Texts without letters count as one word."""
    parts = measured.select("row", F.explode("rest").alias("_part")).select("row", "_part.gram", "_part.n")
    logs = model.logs_of(parts.select("gram").distinct())
    added = parts.join(logs, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("_added"))
    total = F.col("log_sum") - F.coalesce("_added", F.lit(0.0))
    joined = measured.drop("rest").join(added, "row", "left")
    return joined.withColumn("mean_log", total / F.greatest("words", F.lit(1))).drop("row", "log_sum", "_added")


def settled(mean: Column, middle: Column, words: Column, weight: int = 40) -> Column:
    """A mean drawn towards the language's middle, the more the shorter the text is: few words prove little."""
    words = F.greatest(words, F.lit(1))
    return middle + (mean - middle) * F.sqrt(words / (words + weight))
