"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Text is folded first: look-alike letters of other alphabets, full-width forms, digits and signs that
stand for letters, and invisible characters all become plain lower-case letters. One automaton then
finds every entry of the lexicon in one pass. Entries are whole words or beginnings of words; the
longest entry at a place counts. Exception phrases, harmless words and phrases that contain an entry,
take away the hits they cover. The weight found is normalised by the length of the text, and a logistic
curve turns it into a score.

Lexicon, exceptions and curve are learned from labelled rows, of which a bounded sample is used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches, leaving_nothing

# Letters that look like others, and signs used for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"

FOLD = str.maketrans(LOOK_ALIKES | SIGNS | dict.fromkeys(INVISIBLE, ""))
WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 8
WHOLE, START, EXCEPTION = 0, 1, 2
#: Evidence, in nats, that an entry must have against chance.
EVIDENCE = 10.0


def fold(text: str | None) -> str:
    """Text in the form that is matched."""
    text = text or ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(FOLD)


@dataclass
class Lexicon:
    """What a score needs. Entries: (text, whole word or start of a word) to weight."""

    entries: dict[tuple[str, int], float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] | None = None


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        kinds: dict[str, list[tuple[int, float]]] = {}
        for (text, kind), weight in lexicon.entries.items():
            kinds.setdefault(text, []).append((kind, weight))
        for text in lexicon.exceptions:
            kinds.setdefault(fold(text), []).append((EXCEPTION, 0.0))
        self.automaton = ahocorasick.Automaton()
        for text, own in kinds.items():
            if text:
                self.automaton.add_word(text, (len(text), own))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def weight(self, text: str | None) -> tuple[float, int]:
        """Weight of all hits, and words, of a whole text."""
        folded = fold(text)
        if not self.some:
            return 0.0, len(folded.split())
        hits: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, kinds) in self.automaton.iter(folded):
            begin = end - size + 1
            if begin and folded[begin - 1].isalpha():
                continue
            open_end = end + 1 < len(folded) and folded[end + 1].isalpha()
            for kind, weight in kinds:
                if kind != START and open_end:
                    continue
                if kind == EXCEPTION:
                    spared.append((begin, end))
                elif begin not in hits or (size, kind == WHOLE) >= (hits[begin][0], False):
                    hits[begin] = (size, weight)
        for first, last in spared:
            for begin in [b for b, (size, _) in hits.items() if first <= b and b + size - 1 <= last]:
                if hits[begin][0] <= last - first + 1:
                    del hits[begin]
        return sum(w for _, w in hits.values()), len(folded.split())


def features(weight: float, words: int) -> tuple[float, float, float]:
    """What the curve is drawn over: all weight, and weight by length."""
    return 1.0, math.log1p(weight), math.log1p(100 * weight / (words + 20))


def word_features(text: str | None) -> Counter:
    """Words of a text and their beginnings, with how often they occur."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(fold(text))).items():
        if len(word) <= 40:
            out[word, WHOLE] += n
        for size in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            out[word[:size], START] += n
    return out


COUNTS = "feature string, kind int, toxic_docs long, clean_docs long, toxic_n long, clean_n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: dict) -> pa.RecordBatch:
        columns = list(zip(*((f, k, *c) for (f, k), c in counts.items()))) or [()] * 6
        kinds = [pa.string(), pa.int32()] + [pa.int64()] * 4
        names = [c.split()[0] for c in COUNTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    counts: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = word_features(text)
            found["", WHOLE] = sum(n for (_, kind), n in found.items() if kind == WHOLE)
            for key, n in found.items():
                own = counts.setdefault(key, [0, 0, 0, 0])
                own[0 if toxic else 1] += 1
                own[2 if toxic else 3] += n
            if len(counts) > 50_000:
                yield rows(counts)
                counts = {}
    yield rows(counts)


def _evidence(toxic: float, clean: float, share: float) -> float:
    """How unlikely it is that documents with a feature are toxic as often by chance, in nats."""
    p = toxic / (toxic + clean)
    if p <= share:
        return 0.0
    return (toxic + clean) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))


def _weights(lexicon: Lexicon) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.weight(t) for t in batch.column(0).to_pylist()]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            columns = [*rest, pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            names = [*batch.schema.names[1:], "weight", "words"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def draw_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train_rows(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labelled rows outside fold 0, one per document: the fold is the crc32 of the id's digits."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    return known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_entries: int = 5_000) -> Lexicon:
    """A lexicon from the labelled documents outside fold 0.

    At most `most_rows` labelled rows are used, chosen by a hash of their ids; the sample is small
    enough to broadcast and its counts are made on the executors. An entry is a word, or beginning of
    words, that more toxic documents have than chance allows; its weight is the logarithm of how much
    more often it occurs in them. Words with such a beginning that occur in clean documents as often
    as elsewhere are exceptions. Without rows of both classes the lexicon is empty.
    """
    chosen = train_rows(labels).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    sample = known.join(F.broadcast(chosen), "_id").select("text", "_toxic")
    counts = in_small_batches(sample).mapInArrow(leaving_nothing(_count), COUNTS).groupBy("feature", "kind").agg(
        *[F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_n", "clean_n")]
    )
    total = counts.filter("feature = ''").first()
    if total is None or not total.toxic_docs or not total.clean_docs:
        return Lexicon()
    share = total.toxic_docs / (total.toxic_docs + total.clean_docs)
    both, p = F.col("toxic_docs") + F.col("clean_docs"), F.col("toxic_docs") / (F.col("toxic_docs") + F.col("clean_docs"))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    evidence = F.when(p > share, both * (p * F.log(p / share) + rest)).otherwise(0.0)
    ratio = F.log(((F.col("toxic_n") + 0.5) / (total.toxic_n + 1)) / ((F.col("clean_n") + 0.5) / (total.clean_n + 1)))
    judged = counts.filter("feature <> ''").select("feature", "kind", "clean_docs", evidence.alias("evidence"), ratio.alias("ratio"))
    judged = judged.persist()
    best = judged.filter((F.col("evidence") >= EVIDENCE) & (F.col("ratio") >= 1))
    best = best.orderBy(F.desc("evidence"), "feature", "kind").limit(most_entries).collect()
    lexicon = Lexicon({(r.feature, r.kind): min(r.ratio, 6.0) for r in best})
    starts = sorted({f[:SHORTEST] for f, kind in lexicon.entries if kind == START})
    if starts:
        harmless = judged.filter((F.col("kind") == WHOLE) & (F.col("ratio") < 0) & (F.col("clean_docs") >= 3))
        harmless = harmless.filter(F.substring("feature", 1, SHORTEST).isin(starts))
        rows = harmless.orderBy(F.desc("clean_docs"), "feature").limit(most_entries).collect()
        lexicon.exceptions = {r.feature for r in rows if (r.feature, WHOLE) not in lexicon.entries}
    judged.unpersist()
    found = sample.mapInArrow(leaving_nothing(_weights(lexicon)), "_toxic int, weight double, words long").toPandas()
    x = np.array([features(w, n) for w, n in zip(found.weight, found.words)])
    lexicon.curve = draw_curve(x, found["_toxic"].to_numpy().astype(float))
    return lexicon


def score(lexicon: Lexicon, weight: float, words: int) -> float:
    """0 to 1. Nothing is toxic to an empty lexicon."""
    if lexicon.curve is None:
        return 0.0
    z = sum(b * f for b, f in zip(lexicon.curve, features(weight, words)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _scorer(lexicon: Lexicon, keep: list[str], into: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            scores = [score(lexicon, *matcher.weight(t)) for t in texts]
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*keep, into])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str], into: str = "score") -> DataFrame:
    """The columns `keep` of every document, and its score in a new column `into`.

    Whole texts are scored; a missing text is empty, and an empty one scores as a text without hits.
    Repeated rows score alike; an empty table gives an empty result; other columns are not read, and one
    named as `into` can't be kept.
    """
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add(into, "double")
    return in_small_batches(rows).mapInArrow(leaving_nothing(_scorer(lexicon, keep, into)), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Documents that score below `limit` by a lexicon learned from them and their labels; columns are
    those of `docs`."""
    named = docs.toDF(*[c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)])
    scored = score_toxicity(named, learn_lexicon(named, labels), named.columns)
    return scored.filter(F.col("score") < limit).drop("score").toDF(*docs.columns)
