"""A quality classifier by perplexity under a model of trusted text.

An interpolated modified Kneser-Ney model is counted on trusted documents only, into tables that grow with
them. Texts look up the most frequent entries in sorted arrays; all their other grams are joined to the
tables by gram, shard by shard of the shuffle, and the parts of a document's log probability added up. A
passage that a text repeats costs nothing the second time, so that repetition lies below the band and noise
above it. Thresholds are quantiles of the trusted documents of each language, with a margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm import ngrams
from heliograph.llm.common import in_small_batches, may_be_member, member_bits, written

LOW, HIGH = 0.005, 0.995
#: How far the band reaches beyond the quantiles, in parts of their distance.
BELOW, ABOVE = 0.15, 0.15
#: Bits of the filter of trusted ids: 16 for each id, up to 8 MB; beyond, more texts are shuffled.
FEWEST_BITS, MOST_BITS = 1 << 12, 1 << 26


def _means(heads: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = ngrams.symbol_table(), ngrams.task_rows()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if not texts:
                continue
            columns = [batch.column(0), batch.column(1), *ngrams.scored_columns(texts, heads.value, tables, True, row)]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "row", "log_sum", "symbols", "words", "rest"])

    return run


def trusted_ids(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Ids of documents labelled good, outside fold 0 (the crc32 of the id's digits)."""
    good = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("q"))
    return good.filter((F.col("q") == 1) & (F.crc32(F.col("_id").cast("string").cast("binary")) % folds != 0)).select("_id")


def quality_by_trust(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, below: float = BELOW, above: float = ABOVE, head: int = ngrams.HEAD) -> DataFrame:
    """Per document: doc_id, lang, `mean_log` (log perplexity per word, drawn to the language's middle
    in short texts), the thresholds `low` and `high`, and `kept`.

    Thresholds are the two quantiles of the language's trusted documents, moved outwards by `below` and
    `above` times their distance. A language without trusted documents takes those of all trusted ones; without any
    trusted document everything is kept. Missing and empty texts are not kept unless nothing is trusted.
    Repeated rows get equal results; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = trusted_ids(labels)
    # Most texts without trust are left out before the join, so that they need not be shuffled.
    size = min(max(1 << (16 * trusted.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    likely = rows.filter(may_be_member(F.col("doc_id"), member_bits(trusted, "_id", size), size))
    texts = likely.join(trusted, F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    counts = written(ngrams.count_grams(texts), "trusted-counts")
    model = ngrams.Model(counts, head)
    heads = spark.sparkContext.broadcast(model.heads)
    ddl = "doc_id long, lang string, " + ngrams.SCORED
    measured = written(in_small_batches(rows).mapInArrow(_means(heads), ddl), "trusted-means")
    measured = written(ngrams.with_mean(measured, model), "trusted-whole")
    known = measured.join(trusted, F.col("doc_id") == F.col("_id"), "left_semi").filter("symbols > 0")
    middle = F.percentile_approx("mean_log", 0.5, 10_000)
    overall = known.agg(middle.alias("_middle"))
    middles = known.groupBy("lang").agg(middle.alias("middle")).select(F.col("lang").alias("_lang"), "middle")
    centre = overall.first()[0]
    joined = measured.join(middles, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    centred = F.coalesce("middle", F.lit(centre).cast("double"), "mean_log")
    joined = joined.withColumn("mean_log", ngrams.settled(F.col("mean_log"), centred, F.col("words"))).drop("middle", "words")
    joined = written(joined, "trusted-settled")
    known = joined.join(trusted, F.col("doc_id") == F.col("_id"), "left_semi").filter("symbols > 0")
    ends = F.percentile_approx("mean_log", F.array(F.lit(low), F.lit(high)), 10_000)
    whole = known.agg(ends.alias("q")).first()[0]
    bands = known.groupBy("lang").agg(ends.alias("q")).select(F.col("lang").alias("_lang"), "q")
    default = F.array(*[F.lit(x).cast("double") for x in whole]) if whole else F.lit(None).cast("array<double>")
    q = F.coalesce("q", default)
    width = q[1] - q[0]
    banded = joined.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    banded = banded.withColumn("low", q[0] - below * width).withColumn("high", q[1] + above * width)
    kept = F.col("mean_log").between(F.col("low"), F.col("high")) & (F.col("symbols") > 0)
    kept = F.when(F.col("low").isNull(), F.lit(True)).otherwise(kept)
    return banded.select("doc_id", "lang", "mean_log", "low", "high", kept.alias("kept"))
