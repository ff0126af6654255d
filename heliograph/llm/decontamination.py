"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window of a benchmark item occurs in a document only if all of its words do, so one of them is
enough to look for it: the prefix that must be joined is the word that is rarest in the corpus. Rarity
is counted over all documents. Documents give the places of such words, each with the words around it
that a window could reach; the join on the word is bounded by the window's position and length within
the document and verified word by word. The word next to it is part of the join's key, so that a word that is
frequent, or the rarest of many windows, doesn't gather under one key.

Words are first tested against a bit array, made of the benchmark's words, sized by their number and carried as
one value, so that nearly all places without a chance never become rows. It decides nothing: a bit set
by chance costs a row, and no place of a benchmark word is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.llm.common import ascii_lower, fresh, may_be_member, member_bits, text_key, written

#: Everything that is not an ASCII digit or letter; other alphabets count as letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bits of a filter: so many a member, within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for a missing one."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): runs of `size` consecutive words; a shorter item is one window; one without
    words has none."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    at = worded.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at"))
    return at.select("item_id", F.slice("words", F.col("at"), F.lit(size)).alias("window")).distinct()


def filter_size(members: int) -> int:
    """Bits of a filter of so many members."""
    return min(MOST_BITS, max(LEAST_BITS, BITS_EACH << members.bit_length()))


def rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): in how many of all documents each word of the vocabulary occurs."""
    size = filter_size(vocabulary.count())
    bits = member_bits(vocabulary, "word", size)
    own = F.filter(F.array_distinct(words_of(F.col("text"))), lambda w: may_be_member(w, F.col("_bits"), size))
    counted = docs.select("text", bits.alias("_bits")).select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def keyed_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, at, window) for each distinct window: its rarest word, and where that stands first, from
    0. Ties go to the word that sorts first."""
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode("window").alias("at", "word")).join(counts, "word")
    rarest = F.min(F.struct("n", "word", "at")).alias("key")
    return placed.groupBy("window").agg(rarest).select("key.word", "key.at", "window")


def _pair(word: Column, side: Column | int, other: Column) -> Column:
    """A join key of a word and the one after it (side 1), before it (2), or none (0)."""
    return F.xxhash64(word, F.lit(side) if isinstance(side, int) else side, other)


def paired_windows(keys: DataFrame) -> DataFrame:
    """Windows with the `pair` of their rarest word and a neighbour: the next word or, at the end, the one before."""
    after, before = F.get("window", F.col("at") + 1), F.get("window", F.col("at") - 1)
    side = F.when(after.isNotNull(), 1).when(before.isNotNull(), 2).otherwise(0)
    return keys.withColumn("pair", _pair(F.col("word"), side, F.coalesce(after, before, F.lit(""))))


def paired_places(found: DataFrame, keys: DataFrame) -> DataFrame:
    """Places once for each `pair` that windows may have."""
    size = filter_size(keys.count())
    here = F.col("place") - F.col("first")
    after, before = F.get("near", here + 1), F.get("near", here - 1)
    pairs = F.array(
        _pair(F.col("word"), 0, F.lit("")), F.when(after.isNotNull(), _pair(F.col("word"), 1, after)),
        F.when(before.isNotNull(), _pair(F.col("word"), 2, before)),
    )
    spread = found.filter("place > 0").withColumn("pair", F.explode(pairs)).filter("pair IS NOT NULL")
    return spread.withColumn("_bits", member_bits(keys, "pair", size)).filter(may_be_member(F.col("pair"), F.col("_bits"), size)).drop("_bits")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_hash, `n_words`, `n_hit` (words inside any occurrence of a window),
    `n_items`, `items` (ids of the items with an occurring window, sorted as strings).

    Missing texts and texts without words have no words; items without words occur nowhere; whole
    texts of any length are searched; equal windows of several items are searched once; repeated rows
    get equal results each; items without id are searched but not listed; empty tables give empty
    results or no hits; other columns are not read.
    """
    windows = written(item_windows(items, size), "item-windows")
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct(), "window-words")
    keys = written(paired_windows(keyed_windows(windows, rarity(docs, vocabulary))), "window-keys")
    bits_size = filter_size(keys.count())
    bits = member_bits(keys, "word", bits_size)
    # One more entry per document, at place 0, stands for the document itself.
    itself = F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("first"), F.lit("").alias("word"), F.array().cast("array<string>").alias("near")))

    def places(words: Column) -> Column:
        every = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
        chosen = F.filter(every, lambda i: may_be_member(F.element_at(words, i), F.col("_bits"), bits_size))

        def context(i: Column) -> Column:
            first = F.greatest(i - (size - 1), F.lit(1))
            near = F.slice(words, first, i - first + size)
            return F.struct(i.alias("place"), first.alias("first"), F.element_at(words, i).alias("word"), near.alias("near"))

        return F.struct(F.size(words).alias("n_words"), F.concat(itself, F.transform(chosen, context)).alias("found"))

    # A text's words are bound to a variable, for else they would be split again for every use.
    bound = F.get(F.transform(F.array(words_of(F.col("text"))), places), 0)
    listed = docs.select("doc_id", "text", bits.alias("_bits")).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_hash"), bound.alias("own")
    )
    found = listed.select("doc_id", "text_hash", "own.n_words", F.inline("own.found"))
    found = written(found, "benchmark-places")
    start, length = F.col("place") - F.col("at"), F.size("window")
    fits = (start >= F.col("first")) & (start + length - 1 <= F.col("n_words"))
    equal = F.slice("near", start - F.col("first") + 1, length) == F.col("window")
    hits = (
        paired_places(found, keys).drop("word").join(keys, "pair").filter(fits)
        .filter(equal)
        .select("doc_id", "text_hash", start.alias("start"), (start + length).alias("end"), "window")
        .distinct()
    )
    hits = written(hits, "benchmark-hits")
    # Windows that overlap: each adds the words beyond the furthest end so far.
    before = W.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    added = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start")))
    covered = (
        hits.select("doc_id", "text_hash", "start", "end").distinct()
        .withColumn("added", F.greatest(added, F.lit(0)))
        .groupBy("doc_id", "text_hash").agg(F.sum("added").alias("n_hit"))
    )
    in_items = (
        hits.select("doc_id", "text_hash", "window").distinct().join(windows, "window")
        .select("doc_id", "text_hash", "item_id").distinct()
        .groupBy("doc_id", "text_hash").agg(F.count("item_id").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    per_doc = covered.join(in_items, covered["doc_id"].eqNullSafe(in_items["doc_id"]) & (covered["text_hash"] == in_items["text_hash"]))
    per_doc = per_doc.select(covered["doc_id"].alias("_id"), covered["text_hash"].alias("_hash"), "n_hit", "n_items", "items")
    all_docs = found.filter("place = 0").select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    zero = F.lit(0).cast("long")
    return all_docs.join(per_doc, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents that contain no window of any item; columns are those of `docs`, whatever their names.

    Missing and empty texts stay; repeated rows stay or go together; rows without doc_id are judged like
    others; without items, or without documents, the table is returned as it is.
    """
    id_, hash_ = fresh(docs.columns, "_id"), fresh(docs.columns, "_hash")
    hit = contamination(docs, items, size).filter("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key("text") == F.col(hash_))
    return docs.join(hit, same, "left_anti")
