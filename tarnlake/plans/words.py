"""Word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import top_rows

# The default splits on everything outside ASCII word characters, the other one keeps
# accented letters inside words.
ASCII_WORDS = r"\W+"
UNICODE_WORDS = r"[^\p{L}\p{N}]+"


def _windowed(words: DataFrame, count: Column, size: str) -> DataFrame:
    return (
        words.groupBy("word", F.window("ts", size))
        .agg(count.alias("count"))
        .select(
            "word",
            "count",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
        )
    )


def word_count_sum(words: DataFrame, size: str = "1 minute") -> DataFrame:
    """Sum of the counts carried by the messages, per word and minute."""
    return _windowed(words, F.sum("count"), size)


def word_count_rows(words: DataFrame, size: str = "1 minute") -> DataFrame:
    """Number of messages per word and minute."""
    return _windowed(words, F.count("*"), size)


def top_words(word_counts: DataFrame, limit: int = 10) -> DataFrame:
    """The words with the greatest total over all windows."""
    totals = word_counts.groupBy("word").agg(
        F.sum("count").alias("total_count"), F.count("*").alias("window_count")
    )
    return top_rows(totals, F.desc("total_count"), ["word"], limit)


def text_word_count(texts: DataFrame, column: str = "text", pattern: str = ASCII_WORDS) -> DataFrame:
    """Lower-cased words of whole texts and how often they occur."""
    words = texts.select(F.explode(F.split(F.lower(column), pattern)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("count"))
