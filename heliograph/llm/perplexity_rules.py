"""Quality rules with perplexity bands.

Simple counts reject what no model is needed for. The rest is judged by an n-gram model of the whole
corpus: a document stays if its log perplexity per word lies within its language's band, which is drawn from
the quartiles of that language's documents. Far above lies noise, far below lies text that repeats. Words are
runs of letters, so that signs cost without counting: noise made of common signs is as likely by the symbol as prose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import ngrams
from heliograph.llm.common import in_small_batches, written

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
REPEATED = 5
FEWEST_WORDS, MOST_REPEATED = 10, 20
#: How many quartile ranges beyond the quartiles a band reaches, below and above.
BELOW, ABOVE = 2.0, 2.0
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = REPEATED) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array([i for i, w in enumerate(windows) if often[w] > 1])
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size, -1)
    return int((np.cumsum(inside) > 0).sum())


def counted(text: str | None) -> tuple[int, ...]:
    """The counts of `COUNTED` over a whole text."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def _measures(heads: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = ngrams.symbol_table(), ngrams.task_rows()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if not texts:
                continue
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*map(counted, texts)))]
            columns += ngrams.scored_columns(texts, heads.value, tables, False, row)
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *COUNTED, "row", "log_sum", "symbols", "words", "rest"])

    return run


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE, head: int = ngrams.HEAD) -> DataFrame:
    """Per document: doc_id, lang, the counts, `base_failed`, `mean_log` (log perplexity per word, drawn
    to the language's middle in short texts), the band's `low` and `high`, and `kept`.

    Missing and empty texts have no words and fail the base rules. Documents without language are a
    language of their own. Where a language's quartiles coincide, its band has the width of a hundredth
    of a nat. Repeated rows get equal results; an empty table gives an empty result; other columns are not
    read.
    """
    text = F.col("text").cast("string")
    spark = docs.sparkSession
    counts = written(ngrams.count_grams(docs.select(text.alias("text"))), "ngram-counts")
    model = ngrams.Model(counts, head)
    heads = spark.sparkContext.broadcast(model.heads)
    ddl = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTED) + ", " + ngrams.SCORED
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text)
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = written(in_small_batches(rows).mapInArrow(_measures(heads), ddl).withColumn("base_failed", base), "measured")
    measured = written(ngrams.with_mean(measured, model).drop("symbols"), "measured-whole")
    rest = measured.filter("NOT base_failed")
    middles = rest.groupBy("lang").agg(F.percentile_approx("mean_log", 0.5, 10_000).alias("middle"))
    middles = middles.select(F.col("lang").alias("_lang"), "middle")
    near = ngrams.settled(F.col("mean_log"), F.coalesce("middle", "mean_log"), F.col("words"))
    joined = measured.join(middles, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    joined = joined.withColumn("mean_log", near).drop("middle")
    quartiles = F.percentile_approx("mean_log", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    bands = joined.filter("NOT base_failed").groupBy("lang").agg(quartiles.alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01))
    bands = bands.select(
        F.col("lang").alias("_lang"), (F.col("q")[0] - below * spread).alias("low"), (F.col("q")[1] + above * spread).alias("high")
    )
    banded = joined.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang", "words")
    inside = F.coalesce(F.col("mean_log").between(F.col("low"), F.col("high")), F.lit(False))
    return banded.withColumn("kept", ~F.col("base_failed") & inside)
