"""An incremental dictionary: word counts of texts as they arrive, with event-time windows and late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def windowed_counts(stream: DataFrame, time: str, text: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, lemma, f for each window; works on batch and streaming frames alike."""
    words = stream.withWatermark(time, late).select(F.col(time).alias("at"), F.explode(T.tokens(F.col(text))).alias("form"))
    return words.groupBy(F.window("at", width).alias("w"), T.normalize_lemma(F.col("form")).alias("lemma")).agg(F.count("*").alias("f")).select(F.col("w.start").alias("start"), "lemma", "f")
