"""Registered queries of operators on small tables: names, titles, dates, lyricists, and what the charts show.

Values that the test tables lack (Russian names and titles, credits) come from small inline tables, crossed with a table's
keys so that every row of it takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluation, lexicon, sampling
from ..sources import discography
from .queries import _CLASSES, _DRAW, _FUN, _PRED, CNT, REPS, TOK, _predictions, docs, function_table, query, r6, table, tok

#: Inline values. The queries' own; they name nobody.
TITLES = ("Песня", "песня!", "Пeсня (live)", "Ёлка и лес", "Symbol: два", "Липкий пульс", "Сим-бол", "симбoл", "Дом.", "", "A.B... ")
CREDITS = (("И. Лесов", "", "Лесов", False), ("И. Лесов и П. Садов", "", "Лесов", True), ("", "И. Лесов, П. Садов", "Лесов", True), ("", "слова И. Лесов", "Лесов", False), ("", "", "Лесов", True), ("Садов", "И. Лесов", "Лесов", True))


def _inline(values: tuple[str, ...]) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{v}'" for v in values) + "]) AS title)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every inline title: a constant array a row, no join."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*(F.lit(t) for t in TITLES))).alias("title"))


_T = f"t AS (SELECT n_nationkey, title FROM nation, {_inline(TITLES)})"
_KEY = "array_to_string(regexp_extract_all(translate(replace(lower({0}), 'ё', 'е'), 'aceopxykmthb', 'асеорхукмтнв'), '[а-яa-z0-9]+'), ' ')"
_LOOSE = "trim(regexp_replace(regexp_replace(translate(replace(lower({0}), 'ё', 'е'), 'aceopxyk', 'асеорхук'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {_T} SELECT n_nationkey, title, {_LOOSE.format('title')} AS key FROM t")
def loose_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("n_nationkey", "title", T.loose_title_key(F.col("title")).alias("key"))


@query(f"WITH {_T} SELECT n_nationkey, title, lower(regexp_replace(trim(title), '\\.+$', '')) AS key FROM t")
def album_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("n_nationkey", "title", T.album_key(F.col("title")).alias("key"))


@query(f"WITH {_T} SELECT n_nationkey, title, array_to_string(list_filter(regexp_extract_all(replace(lower(title), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w <> 'и'), ' ') AS key FROM t")
def word_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("n_nationkey", "title", T.word_title_key(F.col("title")).alias("key"))


@query(f"WITH {_T} SELECT n_nationkey, title, contains(lower(title), 'symbol') OR contains({_KEY.format('title')}, 'липкий пульс') OR contains({_KEY.format('title')}, 'симбол') AS held_out FROM t")
def held_out_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("n_nationkey", "title", discography.is_held_out(F.col("title")).alias("held_out"))


@query("SELECT c_custkey, trim(regexp_replace('И.' || c_name || '.  Л.' || c_mktsegment, '\\.\\s*', '. ', 'g')) AS person FROM customer")
def normalize_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("И."), "c_name", F.lit(".  Л."), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_person(said).alias("person"))


_MIXED = "['Пeсня', 'Caша', 'only latin', 'слово', 'Bечер и day', 'XOP-хор', '']"


@query(f"""WITH w AS (SELECT n_nationkey, i, unnest(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]+|[^A-Za-zА-Яа-яЁё]+')) AS run, unnest(range(0, len(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]+|[^A-Za-zА-Яа-яЁё]+')))) AS k
  FROM (SELECT n_nationkey, i, ({_MIXED})[i] AS x FROM nation, (SELECT unnest(range(1, 8)) AS i)))
SELECT n_nationkey, i::INT AS i, string_agg(CASE WHEN regexp_matches(run, '[A-Za-z]') AND regexp_matches(run, '[А-Яа-яЁё]') THEN translate(run, 'aceopxykmtbABCEHKMOPTXY', 'асеорхукмтвАВСЕНКМОРТХУ') ELSE run END, '' ORDER BY k) AS fixed FROM w GROUP BY ALL
UNION ALL SELECT n_nationkey, 7, '' FROM nation""")
def fix_mixed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(x) for x in ("Пeсня", "Caша", "only latin", "слово", "Bечер и day", "XOP-хор", "")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(texts).alias("i", "x"))
    return rows.select("n_nationkey", (F.col("i") + 1).alias("i"), T.fix_mixed_script(F.col("x")).alias("fixed"))


_C = "c AS (SELECT unnest([" + ", ".join(f"{{'lyricist': '{a}', 'credit': '{b}', 'surname': '{c}', 'def': {str(d).lower()}}}" for a, b, c, d in CREDITS) + "], recursive := true))"


@query(f"""WITH {_C} SELECT n_nationkey, lyricist, credit, def AS default_to_main, CASE
  WHEN lyricist <> '' THEN contains(lyricist, surname) AND NOT (regexp_matches(lyricist, '[а-яё][-—–]\\s*[А-ЯЁ]|\\s[-—–]\\s') OR regexp_matches(lyricist, '[,/;&]| и '))
  WHEN credit <> '' THEN contains(credit, surname) AND len(regexp_extract_all(credit, '[А-ЯЁ]\\.\\s?[А-ЯЁ][а-яё]+|[А-ЯЁ][а-яё]+ [А-ЯЁ]\\.')) <= 1 ELSE def END AS own FROM nation, c""")
def resolve_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(a).alias("lyricist"), F.lit(b).alias("credit"), F.lit(c).alias("surname"), F.lit(d).alias("default_to_main")) for a, b, c, d in CREDITS))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(each).alias("c")).select("n_nationkey", "c.*")
    own = T.resolve_author(F.col("lyricist"), F.col("credit"), F.col("surname"), F.col("default_to_main"))
    return rows.select("n_nationkey", "lyricist", "credit", "default_to_main", own.alias("own"))


_SECTIONS = ("Синглы", "Антологии", "Концертные Записи", "нет", "Сборники и Синглы")


@query(f"""SELECT c_custkey, section, CASE section WHEN 'Синглы' THEN 'single' WHEN 'Антологии' THEN 'compilation' WHEN 'Концертные Записи' THEN 'live' ELSE 'other' END AS kind,
  CASE WHEN section <> 'Сборники и Синглы' THEN 'studio' WHEN contains(lower(c_name), '1') THEN 'single' ELSE 'compilation' END AS album_kind
FROM (SELECT c_custkey, c_name, ({list(_SECTIONS)})[c_custkey % 5 + 1] AS section FROM customer)""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.element_at(F.array(*(F.lit(x) for x in _SECTIONS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("1"), F.lit("сингл")).alias("album"), section.alias("section"))
    return rows.select("c_custkey", "section", discography.section_kind(F.col("section")).alias("kind"), discography.album_kind(F.col("section"), F.col("album")).alias("album_kind"))


@query("""SELECT p_partkey, p_name AS title, coalesce(lyricist, 'default') AS lyricist FROM part LEFT JOIN
  (SELECT p_name, max('l' || p_brand) AS lyricist FROM part WHERE p_size > 25 GROUP BY p_name) USING (p_name)""")
def lyricist_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    exceptions = part.where("p_size > 25").groupBy(T.loose_title_key(F.col("p_name")).alias("key")).agg(F.max(F.concat(F.lit("l"), "p_brand")).alias("lyricist"))
    return discography.with_lyricist(part.select("p_partkey", F.col("p_name").alias("title")), exceptions, "default")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return discography.first_of_each(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


# Charts and reports


@query(f"WITH {TOK} SELECT author, n_tokens, row_number() OVER (ORDER BY n_tokens DESC, author)::INT AS rank FROM (SELECT author, count(*) AS n_tokens FROM tok GROUP BY author)")
def authors_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranked(tok(spark, sf_dir).groupBy("author").agg(F.count("*").alias("n_tokens")), "n_tokens", "author")


@query("SELECT source AS author, count(*) AS texts, count(DISTINCT lang) AS groups FROM documents GROUP BY source")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy(F.col("source").alias("author")).agg(F.count("*").alias("texts"), F.count_distinct("lang").alias("groups"))


@query(f"WITH {_PRED}, q AS (SELECT * FROM p), {_CLASSES('')} SELECT label, support, row_number() OVER (ORDER BY support DESC, label)::INT AS rank FROM cls")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranked(evaluation.per_class(_predictions(spark, sf_dir)), "support", "label").select("label", "support", "rank")


@query(f"""WITH {TOK}, {CNT}, {_FUN}, a AS (SELECT lemma, sum(f)::DOUBLE AS all_f FROM cnt GROUP BY lemma), s AS (SELECT author, sum(f)::DOUBLE AS n FROM cnt GROUP BY author), g AS (SELECT sum(f)::DOUBLE AS total, sum(f)::DOUBLE / count(DISTINCT author) AS a0 FROM cnt),
p AS (SELECT author, lemma, f, df, f + a0 * all_f / total AS yt, all_f - f + a0 * all_f / total AS yr, n, total, a0 FROM cnt JOIN a USING (lemma) JOIN s USING (author), g WHERE df >= 3 AND lemma NOT IN (SELECT lemma FROM fun)),
z AS (SELECT author, lemma, (ln(yt / (n + a0 - yt)) - ln(yr / (total - n + a0 - yr))) / sqrt(1 / yt + 1 / yr) AS z, df FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY round(z, 9) DESC, lemma)::INT AS rank FROM z) SELECT author, lemma, round(z, 6) AS z, df, rank FROM k WHERE rank <= 8""")
def keyness_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(lexicon.keyness_chart(lexicon.counts(tok(spark, sf_dir)), function_table(spark), 8), "z")


@query(f"WITH {TOK}, {CNT} SELECT lemma FROM cnt WHERE author = 'src0' INTERSECT SELECT lemma FROM cnt WHERE author = 'src1'")
def common_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tok(spark, sf_dir).select("author", "lemma")
    return words.where("author = 'src0'").select("lemma").intersect(words.where("author = 'src1'").select("lemma"))


_BY_GENRE = f"""tok2 AS (SELECT tok.*, d.lang AS genre FROM tok JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id)),
gs AS (SELECT author, genre, count(*) AS n_tokens FROM tok2 GROUP BY ALL), cm AS (SELECT author, CASE WHEN min(n_tokens) >= 5000 THEN 5000 ELSE min(n_tokens) // 500 * 500 END AS n FROM gs GROUP BY author HAVING count(*) > 1),
sz AS (SELECT author, genre, doc_id, count(*) AS size FROM tok2 GROUP BY ALL), dr AS (SELECT *, {_DRAW.format('rep', 'doc_id')} AS h FROM sz JOIN cm USING (author), (SELECT unnest(range(1, {REPS + 1})) AS rep) WHERE n > 0),
cu AS (SELECT *, n - coalesce(sum(size) OVER (PARTITION BY author, genre, rep ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM dr),
ru AS (SELECT author, genre, rep, n, count(DISTINCT lemma) / n AS ttr FROM cu JOIN tok2 USING (author, genre, doc_id) WHERE pos < room GROUP BY author, genre, rep, n)"""


@query(f"WITH {TOK}, {_BY_GENRE} SELECT author, genre, n_tokens, n::BIGINT AS n, round(avg(ttr), 6) AS ttr_mean, round(stddev_samp(ttr), 6) AS ttr_std FROM ru JOIN gs USING (author, genre) GROUP BY author, genre, n_tokens, n")
def genre_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("genre"))
    words = tok(spark, sf_dir).join(kinds, "doc_id")
    return r6(sampling.genre_ttr(words, 5000, 500, REPS).withColumn("n", F.col("n").cast("bigint")), "ttr_mean", "ttr_std")


@query(f"""WITH {TOK}, {_FUN}, ct AS (SELECT author, doc_id, lemma, row_number() OVER (PARTITION BY author, doc_id ORDER BY pos) - 1 AS pos FROM tok WHERE lemma NOT IN (SELECT lemma FROM fun)),
si AS (SELECT author, doc_id, count(*) AS size FROM ct GROUP BY ALL), cn AS (SELECT CASE WHEN min(t) >= 5000 THEN 5000 ELSE min(t) // 1000 * 1000 END AS n FROM (SELECT sum(size) AS t FROM si GROUP BY author)),
dr AS (SELECT *, {_DRAW.format('rep', 'doc_id')} AS h FROM si, cn, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
cu AS (SELECT *, n - coalesce(sum(size) OVER (PARTITION BY author, rep ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM dr),
ru AS (SELECT author, rep, n, count(DISTINCT lemma) / n AS ttr FROM cu JOIN ct USING (author, doc_id) WHERE pos < room GROUP BY author, rep, n)
SELECT author, n::BIGINT AS n, round(avg(ttr), 6) AS ttr_mean, round(stddev_samp(ttr), 6) AS ttr_std FROM ru GROUP BY author, n""")
def content_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = lexicon.content_tokens(tok(spark, sf_dir), function_table(spark))
    sizes = content.groupBy("author").agg(F.count("*").alias("n_tokens"))
    common = sizes.agg(sampling.common_n(sizes, 5000, 1000).cast("bigint").alias("n"))
    each = sizes.select("author").join(F.broadcast(common))  # one row
    return r6(sampling.sampled_ttr_at(content, each, REPS), "ttr_mean", "ttr_std")


@query("""SELECT author, decade, count(*) AS texts FROM (SELECT lang AS author, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN NULL ELSE 1960 + doc_id % 60 END AS y, ((1960 + doc_id % 60) // 10 * 10) || '-е' AS decade FROM documents)
WHERE author IN ('en', 'de') AND coalesce(y, 0) <> 0 GROUP BY ALL""")
def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 11 == 0, None).otherwise(1960 + F.col("doc_id") % 60)
    rows = docs(spark, sf_dir).select(F.col("lang").alias("author"), year.alias("year"))
    return corpus.dated(rows, ["en", "de"]).groupBy("author", T.decade(F.col("year")).alias("decade")).agg(F.count("*").alias("texts"))


@query("""WITH f AS (SELECT o_orderpriority AS model, o_custkey % 5 AS fold, avg(o_totalprice / 1e6) AS macro_f1, avg((o_orderstatus = 'F')::INT) AS accuracy FROM orders GROUP BY ALL)
SELECT model, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std, round(avg(accuracy), 6) AS accuracy_mean FROM f GROUP BY model""")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 5).alias("fold"))
    folds = folds.agg(F.avg(F.col("o_totalprice") / 1e6).alias("macro_f1"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"))
    return r6(evaluation.fold_summary(folds), "macro_f1_mean", "macro_f1_std", "accuracy_mean")
