"""Periodic runs of words, found from Lyndon roots, and texts with such runs collapsed.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its period starts,
somewhere, with a Lyndon word, and under one of the two orders of the words (ascending or descending) that
word is the longest Lyndon word at its place. The first phase of Baier's suffix sorter groups suffixes by
exactly that word: groups are taken from the highest down, and every suffix of one appends its word to the
nearest suffix on its left that isn't taken yet. The grouping under both orders hence gives all roots, and
equal words in a row are members of one group at equal distances. From there a root is extended to
both sides by longest common extensions.

A run of at least six words and four periods agrees with itself, shifted by its period, over five words or
more, so each of its words lies in a five-word window that occurs again. Only stretches of such words are
sorted, each by itself; no run is lost or cut by that. Everything happens inside the task that reads a
document: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches

#: The least length of a run, in words and in periods, and the window that its words share.
WORDS, PERIODS, WINDOW = 6, 4, 5

RUN = "struct<start:long,length:long,period:long>"


def lyndon_groups(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position a number of the group and the length of the longest Lyndon word that starts there;
    positions are in one group if and only if these words are equal."""
    n = len(ranks)
    letters, group = np.unique(ranks, return_inverse=True)
    group = group.tolist()
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(letters)
    # Groups in a chain by order; `above` is only needed to insert.
    below = list(range(-1, len(letters) - 1))
    above = list(range(1, len(letters) + 1))
    # left[i + 1] leads to the nearest position up to i that isn't taken; slot 0 stands for none.
    left = list(range(n + 1))
    above[-1] = -1
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            left[i + 1] = i
        ends: dict[int, int] = {}
        for i in own:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i + 1] = j
            if j:
                ends[j - 1] = ends.get(j - 1, 0) + 1
        # More repetitions sort higher; each new group goes right above the one that it leaves.
        made: dict[tuple[int, int], int] = {}
        for j, times in sorted(ends.items(), key=lambda e: -e[1]) if len(ends) > 1 else ends.items():
            old = group[j]
            new = made.get((old, times))
            if new is None:
                new = made[old, times] = len(members)
                members.append([])
                length.append(length[old] + times * length[g])
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
            group[j] = new
            members[new].append(j)
        g = below[g]
    numbers = np.array(group, np.int64)
    return numbers, np.array(length, np.int64)[numbers]


def common_extension(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i < j on are the same."""
    done, step = 0, 16
    while True:
        a, b = x[i + done : i + done + step], x[j + done : j + done + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return done + int(differ[0])
        done += len(b)
        if len(b) < step:
            return done
        step *= 4


def runs_of(ranks: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and then period."""
    n, found = len(ranks), set()
    backward = ranks[::-1]
    for order in (ranks, -ranks):
        group, period = lyndon_groups(order)
        at = np.arange(n)
        # Any run has three roots in a row; the first of them is extended.
        last = at + 2 * period
        at = at[last < n]
        p = period[at]
        at = at[(group[at] == group[at + p]) & (group[at] == group[at + 2 * p])]
        p = period[at]
        at = at[(at < p) | (group[at - p] != group[at])]
        for i in at.tolist():
            p = int(period[i])
            more = common_extension(backward, n - i - p, n - i) if i else 0
            length = more + p + common_extension(ranks, i, i + p)
            if length >= max(WORDS, PERIODS * p):
                found.add((i - more, length, p))
    return sorted(found)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def repeated_stretches(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of several documents' words in a row, those in a window found twice in their document, as a mask.
    Windows are compared by hashes: a collision only adds words."""
    inside = np.zeros(len(ids), bool)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if len(ids) < WINDOW:
        return inside
    keys = doc[: len(ids) - WINDOW + 1].astype(np.uint64)
    for k in range(WINDOW):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - WINDOW + 1 + k].astype(np.uint64))
    starts = np.flatnonzero(doc[: len(keys)] == doc[WINDOW - 1 :])
    keys = keys[starts]
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    several = np.zeros(len(keys), bool)
    several[order[1:][equal]] = True
    several[order[:-1][equal]] = True
    for k in range(WINDOW):
        inside[starts[several] + k] = True
    return inside


def _document_runs(ids: np.ndarray, inside: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    found = []
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= WORDS:
            found += [(a + s, length, p) for s, length, p in runs_of(ids[a:b])]
    return sorted(found)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    stay = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        stay[start + period] += 1
        stay[start + length] -= 1
    stay = np.cumsum(stay[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]).decode()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64)
        ends = np.cumsum([len(words) for words in texts])
        inside = repeated_stretches(ids, ends)
        runs, collapsed = [], []
        for words, end in zip(texts, ends.tolist()):
            begin = end - len(words)
            mask = inside[begin:end]
            own = _document_runs(ids[begin:end], mask) if mask.any() else []
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            collapsed.append(_collapsed(words, own) if own else b" ".join(words).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(runs, kind), pa.array(collapsed, pa.string())], names=[*names, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns `keys` of `docs` with `runs`, an array of (start, length, period) in words by start and
    then period, and `collapsed`, the text with one space between words and each run cut to its first period.

    Words are what lies between ASCII white space, compared as written. Texts that are missing, empty or
    blank have no run and an empty `collapsed`; whole texts of any length count; repeated rows stay, each
    with its own result; an empty table gives an empty result; other columns of `docs` are not read. Keys
    may have any name but `text`, `runs` and `collapsed`.
    """
    rows = in_small_batches(docs.select(*keys, F.col("text").cast("string").alias("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(_runs, f"{schema}, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """Of an array of runs the one with the most periods, exactly compared; ties go to the smallest start,
    then period; null without runs."""
    def better(best: Column, run: Column) -> Column:
        # Runs come by start and period: only more periods replace what was found earlier.
        more = run["length"].cast("decimal(19,0)") * best["period"].cast("decimal(19,0)") > best["length"].cast("decimal(19,0)") * run["period"].cast("decimal(19,0)")
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def repeated_by_rule(text: Column, number: Column) -> Column:
    """Test texts with a run: if `number` is divisible by ten, the words from one on repeat with a period,
    both taken from the number's other digits; other texts, and all without words, stay as they are."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    rest = F.floor(number / 10)
    begin = rest % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - begin) / (3 + rest % 8))
    # Whole arrays at once: a function per word would split the text again for each.
    first = F.slice(words, F.lit(1), begin.cast("int"))
    again = F.flatten(F.array_repeat(F.slice(words, (begin + 1).cast("int"), period.cast("int")), F.ceil((n - begin) / period).cast("int")))
    one = F.concat(first, F.slice(again, F.lit(1), (n - begin).cast("int")))
    return F.when((number % 10 == 0) & (n > 0), F.array_join(one, " ")).otherwise(text)
