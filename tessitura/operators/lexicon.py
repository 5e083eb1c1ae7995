"""Counting words: one token frame, one count frame, and dictionaries, keyness, exclusive and period vocabularies from them.

tokens: author, doc_id, pos (place in the text), lemma, and tag where a part of speech is known. counts: author, lemma,
f (occurrences), df (texts). All are hash aggregates with a partial step before the exchange, so a word that is in every
text costs a row a task, not a row an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Closed-class tags, and lemmas that count as function words whatever their tag.
FUNCTION_TAGS = ("ADP", "CCONJ", "SCONJ", "PART", "PRON", "DET", "AUX")
FUNCTION_LEMMAS = (
    "так там тут здесь где куда откуда туда сюда оттуда отсюда когда тогда всегда никогда иногда как зачем почему отчего "
    "оттого потому поэтому затем потом везде нигде никуда всюду уже еще вот вон нет да лишь только даже сам быть"
).split()


def tokens(docs: DataFrame, author: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """author, doc_id, pos, form, lemma of every word."""
    exploded = docs.select(F.col(author).alias("author"), F.col(key).alias("doc_id"), F.posexplode(T.tokens(F.col(text))).alias("pos", "form"))
    return exploded.withColumn("lemma", T.normalize_lemma(F.col("form")))


def counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, lemma, f, df."""
    keys = keys or ("author",)
    by_doc = tokens.groupBy(*keys, "lemma", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy(*keys, "lemma").agg(F.sum("n").alias("f"), F.count("*").alias("df"))


def is_function(tag: Column, lemma: Column) -> Column:
    return tag.isin(*FUNCTION_TAGS) | lemma.isin(*FUNCTION_LEMMAS)


def frequency_table(tokens: DataFrame) -> DataFrame:
    """author, lemma, tag, f, ipm, df, function, rank: tag is the most frequent one, the first seen on ties."""
    each = tokens.groupBy("author", "lemma", "tag", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    by_tag = each.groupBy("author", "lemma", "tag").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "p")).alias("first"))
    modal = by_tag.groupBy("author", "lemma").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "tag")).alias("m"), F.sum("n").alias("f"))
    df = each.groupBy("author", "lemma").agg(F.count_distinct("doc_id").alias("df"))
    total = F.sum("f").over(Window.partitionBy("author"))
    rows = modal.join(df, ["author", "lemma"]).select("author", "lemma", F.col("m.tag").alias("tag"), "f", (F.col("f") * 1_000_000 / total).alias("ipm"), "df")
    rows = rows.withColumn("function", is_function(F.col("tag"), F.col("lemma")))
    order = Window.partitionBy("author").orderBy(F.desc("df"), F.desc("f"), "lemma")
    return rows.withColumn("rank", F.row_number().over(order))


def function_lemmas(table: DataFrame) -> DataFrame:
    """Lemmas that any author's dictionary flags."""
    return table.where("function").select("lemma").distinct()


def most_frequent(table: DataFrame, n: int, function_only: bool = False) -> DataFrame:
    """The n most frequent lemmas of a dictionary of one group: lemma, f; ties by lemma."""
    rows = table.where("function") if function_only else table
    return rows.orderBy(F.desc("f"), "lemma").limit(n).select("lemma", "f")


def log_odds_z(f: Column, n: Column, rest: Column, n_rest: Column, prior: Column, n_prior: Column, alpha0: Column) -> Column:
    """Log-odds with an informative Dirichlet prior, divided by its standard deviation."""
    alpha = alpha0 * prior / n_prior
    yt, yr = f + alpha, rest + alpha
    delta = F.log(yt / (n + alpha0 - yt)) - F.log(yr / (n_rest + alpha0 - yr))
    return delta / F.sqrt(1 / yt + 1 / yr)


def dunning_g2(f: Column, n: Column, rest: Column, n_rest: Column) -> Column:
    """Signed log-likelihood over the two cells of the word itself; null where there is no rest to compare with."""
    share = (f + rest) / (n + n_rest)
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    g2 = 2 * (cell(f, n * share) + cell(rest, n_rest * share))
    return F.when(n_rest > 0, F.when(f / n >= rest / n_rest, g2).otherwise(-g2))


def keyness(counted: DataFrame) -> DataFrame:
    """author, lemma, z, g2, f, df, f_rest, rank of every author's words against all other authors'.

    The words of an author are compared with totals of the same count frame; the prior has the tokens of an average
    author. rank: by falling z rounded to nine places, then lemma.
    """
    by_lemma = Window.partitionBy("lemma")
    # One row an author: a broadcast whose size is the number of authors; larger ones are shuffled by the optimizer.
    sizes = counted.groupBy("author").agg(F.sum("f").alias("n"))
    whole = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("authors"))
    rows = counted.withColumn("prior", F.sum("f").over(by_lemma)).join(sizes, "author").join(F.broadcast(whole))
    rest, n_rest = F.col("prior") - F.col("f"), F.col("total") - F.col("n")
    z = log_odds_z(F.col("f"), F.col("n"), rest, n_rest, F.col("prior"), F.col("total"), F.col("total") / F.col("authors"))
    rows = rows.select("author", "lemma", z.alias("z"), dunning_g2(F.col("f"), F.col("n"), rest, n_rest).alias("g2"), "f", "df", rest.alias("f_rest"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc(F.round("z", 9)), "lemma")))


def unique_lemmas(counted: DataFrame, function: DataFrame, min_df: int = 2) -> DataFrame:
    """author, lemma, df, f, rank of content lemmas that one author alone uses, in min_df texts or more."""
    owned = counted.groupBy("lemma").agg(F.count("*").alias("owners"), F.min("author").alias("author"), F.sum("f").alias("f"), F.sum("df").alias("df"))
    rows = owned.where((F.col("owners") == 1) & (F.col("df") >= min_df)).join(function, "lemma", "left_anti")
    order = Window.partitionBy("author").orderBy(F.desc("df"), F.desc("f"), "lemma")
    return rows.select("author", "lemma", "df", "f", F.row_number().over(order).alias("rank"))


def unique_summary(counted: DataFrame, unique: DataFrame, top: int = 30) -> DataFrame:
    """author, n_tokens, n_types, n_unique, unique_share, unique_per_10k, top."""
    sizes = counted.groupBy("author").agg(F.sum("f").alias("n_tokens"), F.count("*").alias("n_types"))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "lemma"))))
    found = unique.groupBy("author").agg(F.count("*").alias("n"), F.array_join(F.transform(best, lambda x: x["lemma"]), " ").alias("top"))
    n = F.coalesce("n", F.lit(0))
    return sizes.join(found, "author", "left").select(
        "author", "n_tokens", "n_types", n.alias("n_unique"), (n / F.col("n_types")).alias("unique_share"), (n * 10_000 / F.col("n_tokens")).alias("unique_per_10k"), F.coalesce("top", F.lit("")).alias("top")
    )


def lexicon_hits(tokens: DataFrame, lexicon: DataFrame, *keys: str) -> DataFrame:
    """keys, doc_id, lexicon, hits, words of each text and lexicon (lexicon: lexicon, lemma)."""
    words = tokens.groupBy(*keys, "doc_id").agg(F.count("*").alias("words"))
    hits = tokens.join(lexicon, "lemma").groupBy("lexicon", "doc_id").agg(F.count("*").alias("hits"))
    named = lexicon.select("lexicon").distinct()
    return words.join(F.broadcast(named)).join(hits, ["lexicon", "doc_id"], "left").select(*keys, "doc_id", "lexicon", F.coalesce("hits", F.lit(0)).alias("hits"), "words")


def lexicon_rates(hits: DataFrame, *keys: str) -> DataFrame:
    """keys, lexicon, texts, words, per_1000, share (of texts with a hit)."""
    return hits.groupBy(*keys, "lexicon").agg(
        F.count("*").alias("texts"), F.sum("words").alias("words"), (F.sum("hits") * 1000 / F.sum("words")).alias("per_1000"), F.avg((F.col("hits") > 0).cast("double")).alias("share")
    )


def period_keyness(tokens: DataFrame, period: str, min_df: int = 3, top: int = 40) -> DataFrame:
    """author, period, lemma, z, f, df, rank: a period's words against the same author's other periods."""
    counted = counts(tokens, "author", period)
    sizes = counted.groupBy("author", period).agg(F.sum("f").alias("n"))
    totals = sizes.groupBy("author").agg(F.sum("n").alias("total"))
    rows = counted.withColumn("prior", F.sum("f").over(Window.partitionBy("author", "lemma"))).join(sizes, ["author", period]).join(totals, "author")
    z = log_odds_z(F.col("f"), F.col("n"), F.col("prior") - F.col("f"), F.col("total") - F.col("n"), F.col("prior"), F.col("total"), F.col("n"))
    kept = rows.select("author", period, "lemma", z.alias("z"), "f", "df").where(F.col("df") >= min_df)
    order = Window.partitionBy("author", period).orderBy(F.desc(F.round("z", 9)), "lemma")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def content_tokens(tokens: DataFrame, function: DataFrame) -> DataFrame:
    """author, doc_id, pos, lemma of the tokens that are no function words, with places counted anew in each text."""
    kept = tokens.select("author", "doc_id", "pos", "lemma").join(function.select("lemma"), "lemma", "left_anti")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("author", "doc_id").orderBy("pos")) - 1)


def keyness_chart(counted: DataFrame, function: DataFrame, k: int, min_df: int = 3) -> DataFrame:
    """author, lemma, z, df, rank of each author's k content lemmas with the highest log-odds z, in min_df texts or more."""
    kept = keyness(counted).where(F.col("df") >= min_df).join(function.select("lemma"), "lemma", "left_anti")
    order = Window.partitionBy("author").orderBy(F.desc(F.round("z", 9)), "lemma")
    return kept.select("author", "lemma", "z", "df", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
