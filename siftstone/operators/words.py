"""Word statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftstone.functions.scalars import share_bar

SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def words_of(text: Column) -> Column:
    """Words of 3 to 32 characters and at most 128 bytes, in lower case; lengths are tested before the case changes."""
    parts = F.split(text, SEPARATORS)
    kept = F.filter(parts, lambda w: F.char_length(w).between(3, 32) & F.octet_length(w).between(3, 128))
    return F.transform(kept, lambda w: F.lower(w))


def word_freq(docs: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(by..., word, total_count, doc_count)``. Null texts have no words; repeated rows count as often as they occur.

    Each text leaves the scan stage as its words and, once more, as its different words, and both are summed there:
    the shuffle carries a row per word and task.
    """
    by = by or []
    words = words_of(F.col(text))
    all_ = F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1).alias("t"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.lit(0).alias("t"), F.lit(1).alias("d")))
    rows = docs.select(*by, F.explode(F.concat(all_, once)).alias("w"))
    return rows.groupBy(*by, F.col("w.word").alias("word")).agg(F.sum("w.t").alias("total_count"), F.sum("w.d").alias("doc_count"))


def top_words(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent words with rank, share of the shown total in percent, and bar. Ties go by word."""
    top = freq.orderBy(F.desc("total_count"), "word").limit(n)
    all_ = W.partitionBy(F.lit(0))  # over the n shown rows only
    return top.select(
        F.row_number().over(all_.orderBy(F.desc("total_count"), "word")).alias("rank"), "word", "total_count", "doc_count",
        F.round(100.0 * F.col("total_count") / F.sum("total_count").over(all_), 4).alias("pct"),
        share_bar("total_count", F.max("total_count").over(all_)).alias("bar"),
    )
