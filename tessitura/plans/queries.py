"""The registered queries: the library's operators on the test tables, each with DuckDB SQL that gives the same rows.

Mapping: author = documents.source or lang, text = documents.text, group (album) = source, year = 1960 + doc_id mod 60.
Doubles are rounded to six places on both sides. html_text, html_links, nb_cross_validation and openset_scores have no SQL; the tests run
the page and model operators behind them on small inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluation, features, lexicon, models, sampling
from ..sources import html
from ..streaming import dictionary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A small lexicon of tags, and two lexicons of frequent words of the test texts.
TAGS = {"the": "DET", "of": "ADP", "and": "CCONJ", "in": "ADP", "is": "AUX", "that": "SCONJ", "it": "PRON", "to": "PART", "der": "DET", "die": "DET", "und": "CCONJ", "de": "ADP", "la": "DET", "le": "DET", "et": "CCONJ", "el": "DET", "y": "CCONJ", "en": "ADP"}
LEXICONS = {"articles": ("the", "der", "die", "la", "le", "el"), "links": ("and", "und", "et", "y")}
SAMPLE_N, REPS, BOOT, SHUFFLES = 5000, 100, 2000, 20
D6 = 6

_TAG_SQL = "CASE " + " ".join(f"WHEN lemma = '{k}' THEN '{v}'" for k, v in TAGS.items()) + " WHEN regexp_matches(form, '^\\p{Lu}') THEN 'PROPN' ELSE 'NOUN' END"
_FUNCTION_SQL = f"(tag IN ({', '.join(f"'{t}'" for t in lexicon.FUNCTION_TAGS)}) OR lemma IN ({', '.join(f"'{x}'" for x in lexicon.FUNCTION_LEMMAS)}))"
#: Token frame by source; {by} is the author column.
_TOK = """tok AS (
  SELECT author, doc_id, i - 1 AS pos, forms[i] AS form, replace(lower(forms[i]), 'ё', 'е') AS lemma
  FROM (SELECT {by} AS author, doc_id, forms, unnest(range(1, len(forms) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}+(?:[''’-]\\p{{L}}+)*') AS forms FROM documents)))"""
TOK = _TOK.format(by="source")
TOK_LANG = _TOK.format(by="lang")
CNT = "cnt AS (SELECT author, lemma, sum(n)::BIGINT AS f, count(*) AS df FROM (SELECT author, lemma, doc_id, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL)"
_DRAW = "('0x' || substr(md5('20260928:' || {0} || ':' || {1}), 1, 8))::BIGINT"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tok(spark: SparkSession, sf_dir: str, by: str = "source") -> DataFrame:
    return lexicon.tokens(docs(spark, sf_dir), by)


def words(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """author, doc_id, lemmas of each text."""
    return docs(spark, sf_dir).select(F.col(by).alias("author"), "doc_id", F.transform(T.tokens(F.col("text")), T.normalize_lemma).alias("lemmas"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, D6) + F.lit(0.0) for n in names})  # no negative zero


def tagged(tokens: DataFrame) -> DataFrame:
    tag = F.when(F.col("form").rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")
    known = F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))
    return tokens.withColumn("tag", F.coalesce(F.element_at(known, F.col("lemma")), tag))


def function_table(spark: SparkSession) -> DataFrame:
    """The stop words of the lexicon as a table of one column."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in TAGS))).alias("lemma"))


_FUN = f"fun AS (SELECT unnest([{', '.join(f"'{x}'" for x in TAGS)}]) AS lemma)"
_LEX = "lex AS (" + " UNION ALL ".join(f"SELECT '{k}' AS lexicon, unnest([{', '.join(f"'{w}'" for w in v)}]) AS lemma" for k, v in LEXICONS.items()) + ")"


def lexicon_table(spark: SparkSession) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("lexicon"), F.lit(w).alias("lemma")) for k, v in LEXICONS.items() for w in v))
    return spark.range(1).select(F.explode(pairs).alias("p")).select("p.*")


# Dictionaries

_FREQ = f"""WITH {TOK}, t AS (SELECT *, {_TAG_SQL} AS tag FROM tok),
by_tag AS (SELECT author, lemma, tag, count(*) AS n, min((doc_id, pos)) AS first FROM t GROUP BY ALL),
modal AS (SELECT author, lemma, min((-n, first, tag)) AS m, sum(n)::BIGINT AS f FROM by_tag GROUP BY ALL),
d AS (SELECT author, lemma, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL),
freq AS (SELECT author, lemma, m[3] AS tag, f, round(f * 1000000 / sum(f) OVER (PARTITION BY author), 6)::DOUBLE AS ipm, df FROM modal JOIN d USING (author, lemma)),
flagged AS (SELECT *, {_FUNCTION_SQL} AS function FROM freq)"""


@query(_FREQ + " SELECT author, lemma, tag, f, ipm, df, function, row_number() OVER (PARTITION BY author ORDER BY df DESC, f DESC, lemma)::INT AS rank FROM flagged")
def freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(lexicon.frequency_table(tagged(tok(spark, sf_dir))), "ipm")


@query(_FREQ + " SELECT DISTINCT lemma FROM flagged WHERE function")
def function_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.function_lemmas(lexicon.frequency_table(tagged(tok(spark, sf_dir))))


@query(f"WITH {TOK} SELECT lemma, count(*) AS f FROM tok GROUP BY lemma ORDER BY f DESC, lemma LIMIT 150")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.most_frequent(tok(spark, sf_dir).groupBy("lemma").agg(F.count("*").alias("f")), 150)


@query(f"WITH {TOK}, {CNT} SELECT author, lemma, f, df FROM cnt")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.counts(tok(spark, sf_dir))


# Keyness

_KEY = f"""WITH {TOK}, {CNT}, s AS (SELECT author, sum(f) AS n FROM cnt GROUP BY author), w AS (SELECT sum(n)::DOUBLE AS total, count(*) AS authors FROM s),
p AS (SELECT cnt.*, n::DOUBLE AS n, total, total / authors AS a0, sum(f) OVER (PARTITION BY lemma)::DOUBLE AS prior FROM cnt JOIN s USING (author), w),
q AS (SELECT *, f + a0 * prior / total AS yt, prior - f + a0 * prior / total AS yr, (prior - f)::BIGINT AS f_rest, total - n AS n_rest, prior / total AS share FROM p),
key AS (SELECT author, lemma, (ln(yt / (n + a0 - yt)) - ln(yr / (n_rest + a0 - yr))) / sqrt(1 / yt + 1 / yr) AS z,
  CASE WHEN n_rest > 0 THEN CASE WHEN f / n >= f_rest / n_rest THEN 1 ELSE -1 END * 2 * (f * ln(f / (n * share)) + CASE WHEN f_rest > 0 THEN f_rest * ln(f_rest / (n_rest * share)) ELSE 0 END) END AS g2, f, df, f_rest FROM q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY round(z, 9) DESC, lemma)::INT AS rank FROM key)"""


def _keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.keyness(lexicon.counts(tok(spark, sf_dir)))


@query(_KEY + " SELECT author, lemma, round(z, 6) AS z, f, df, f_rest FROM ranked")
def keyness_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_keyness(spark, sf_dir).select("author", "lemma", "z", "f", "df", "f_rest"), "z")


@query(_KEY + " SELECT author, lemma, round(g2, 6) + 0.0::DOUBLE AS g2, f, df, f_rest FROM ranked")
def keyness_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_keyness(spark, sf_dir).select("author", "lemma", "g2", "f", "df", "f_rest"), "g2")


@query(_KEY + " SELECT author, lemma, round(z, 6) AS z, rank FROM ranked WHERE rank <= 40")
def keyness_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_keyness(spark, sf_dir).where("rank <= 40").select("author", "lemma", "z", "rank"), "z")


_UNI = f"""WITH {TOK}, {CNT}, {_FUN}, own AS (SELECT lemma, min(author) AS author, sum(f)::BIGINT AS f, sum(df)::BIGINT AS df FROM cnt GROUP BY lemma HAVING count(*) = 1),
uni AS (SELECT author, lemma, df, f, row_number() OVER (PARTITION BY author ORDER BY df DESC, f DESC, lemma)::INT AS rank FROM own WHERE df >= 2 AND lemma NOT IN (SELECT lemma FROM fun))"""


@query(_UNI + " SELECT author, lemma, df, f, rank FROM uni")
def unique_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unique_lemmas(lexicon.counts(tok(spark, sf_dir)), function_table(spark))


@query(_UNI + """, a AS (SELECT author, sum(f)::BIGINT AS n_tokens, count(*) AS n_types FROM cnt GROUP BY author),
u AS (SELECT author, count(*) AS n, array_to_string(list(lemma ORDER BY rank) FILTER (rank <= 30), ' ') AS top FROM uni GROUP BY author)
SELECT author, n_tokens, n_types, coalesce(n, 0) AS n_unique, round(coalesce(n, 0) / n_types, 6) AS unique_share, round(coalesce(n, 0) * 10000 / n_tokens, 6) AS unique_per_10k, coalesce(top, '') AS top FROM a LEFT JOIN u USING (author)""")
def unique_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lexicon.counts(tok(spark, sf_dir))
    return r6(lexicon.unique_summary(counted, lexicon.unique_lemmas(counted, function_table(spark))), "unique_share", "unique_per_10k")


# Richness

@query(f"WITH {TOK} SELECT author, count(*) AS n_tokens, count(DISTINCT lemma) AS n_types, round(count(DISTINCT lemma) / count(*), 6) AS ttr FROM tok GROUP BY author")
def ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.ttr(tok(spark, sf_dir)), "ttr")


def _runs(n: int, reps: int) -> str:
    draw = _DRAW.format("rep", "doc_id")
    return f"""sizes AS (SELECT author, doc_id, count(*) AS size FROM tok GROUP BY ALL),
drawn AS (SELECT *, {draw} AS h FROM sizes, (SELECT unnest(range(1, {reps + 1})) AS rep) WHERE author IN (SELECT author FROM sizes GROUP BY author HAVING sum(size) >= {n})),
cum AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY author, rep ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
runs AS (SELECT author, rep, doc_id, lemma FROM cum JOIN tok USING (author, doc_id) WHERE before < {n} AND pos < {n} - before)"""


@query(f"""WITH {TOK}, {_runs(SAMPLE_N, REPS)}, each AS (SELECT author, rep, count(DISTINCT lemma) / {SAMPLE_N} AS ttr FROM runs GROUP BY ALL)
SELECT author, {SAMPLE_N} AS n, round(avg(ttr), 6) AS ttr_mean, round(stddev_samp(ttr), 6) AS ttr_std FROM each GROUP BY author""")
def sampled_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.sampled_ttr(tok(spark, sf_dir), SAMPLE_N, REPS), "ttr_mean", "ttr_std")


_SIZES = (1000, 2000, 3500, 5000)


@query(f"""WITH {TOK}, sizes AS (SELECT author, doc_id, count(*) AS size FROM tok GROUP BY ALL), rich AS (SELECT author, sum(size) AS t FROM sizes GROUP BY author),
drawn AS (SELECT *, {_DRAW.format('rep', 'doc_id')} AS h FROM sizes, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
cum AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY author, rep ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
runs AS (SELECT author, rep, lemma, min(before + pos) AS first FROM cum JOIN tok USING (author, doc_id) WHERE before + pos < {max(_SIZES)} GROUP BY ALL),
every AS (SELECT author, rep, n, count(*) FILTER (first < n) / n AS ttr FROM runs JOIN rich USING (author), (SELECT unnest({list(_SIZES)}) AS n) WHERE t >= n GROUP BY author, rep, n)
SELECT author, n::INT AS n, round(avg(ttr), 6) AS ttr_mean, round(stddev_samp(ttr), 6) AS ttr_std FROM every GROUP BY ALL""")
def ttr_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.sampled_ttr_by_n(tok(spark, sf_dir), list(_SIZES), REPS), "ttr_mean", "ttr_std")


@query(f"""WITH {TOK}, {_FUN}, {_runs(SAMPLE_N, REPS)},
b AS (SELECT rep, author, lemma, count(DISTINCT doc_id) AS df FROM runs GROUP BY ALL),
o AS (SELECT rep, lemma, min(author) AS author, sum(df) AS df FROM b GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT author, rep, count(*) AS c FROM o WHERE df >= 2 AND lemma NOT IN (SELECT lemma FROM fun) GROUP BY ALL),
e AS (SELECT author, rep, coalesce(c, 0) AS c FROM (SELECT DISTINCT author, rep FROM runs) LEFT JOIN c USING (author, rep))
SELECT author, {SAMPLE_N} AS n, round(avg(c), 6) AS unique_mean, round(stddev_samp(c), 6) AS unique_std FROM e GROUP BY author""")
def sampled_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.sampled_unique(tok(spark, sf_dir), function_table(spark), SAMPLE_N, REPS), "unique_mean", "unique_std")


_CURVE = f"""WITH {TOK}, m AS (SELECT author, doc_id, pos, (row_number() OVER (PARTITION BY author, lemma ORDER BY doc_id, pos) = 1)::INT AS fresh FROM tok),
curve AS (SELECT author, row_number() OVER w::INT AS n, (sum(fresh) OVER w)::BIGINT AS types FROM m WINDOW w AS (PARTITION BY author ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(_CURVE + " SELECT author, n, types FROM curve")
def growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.growth_curve(tok(spark, sf_dir))


_MEAN = f"""WITH {{}}, k AS (SELECT author, doc_id, pos, lemma, rep, {_DRAW.format('rep', 'doc_id')} AS h FROM tok, (SELECT unnest(range(1, {SHUFFLES + 1})) AS rep)),
m AS (SELECT *, (row_number() OVER (PARTITION BY author, rep, lemma ORDER BY h, doc_id, pos) = 1)::INT AS fresh FROM k),
c AS (SELECT author, row_number() OVER w::INT AS n, sum(fresh) OVER w AS types FROM m WINDOW w AS (PARTITION BY author, rep ORDER BY h, doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT author, n, avg(types) AS types FROM c GROUP BY ALL)"""


@query(_MEAN.format(TOK) + """, e AS (SELECT author, max(n) AS last FROM curve GROUP BY author HAVING max(n) > 100),
g AS (SELECT DISTINCT author, (CASE WHEN i = 0 THEN 100 WHEN i = 49 THEN last ELSE floor(100 * pow(last / 100.0::DOUBLE, i / 49.0::DOUBLE)) END)::INT AS n FROM e, (SELECT unnest(range(0, 50)) AS i))
SELECT author, round(exp(regr_intercept(ln(types), ln(n))), 6) AS heaps_k, round(regr_slope(ln(types), ln(n)), 6) AS heaps_beta, round(regr_r2(ln(types), ln(n)), 6) AS heaps_r2 FROM curve JOIN g USING (author, n) GROUP BY author""")
def heaps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.heaps_fit(sampling.mean_growth_points(words(spark, sf_dir, "source"), SHUFFLES)), "heaps_k", "heaps_beta", "heaps_r2")


@query(_MEAN.format(TOK_LANG) + " SELECT author, n, round(types, 6) AS types FROM curve")
def mean_growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.mean_growth_curve(words(spark, sf_dir, "lang"), SHUFFLES), "types")


# Chronology

_DEC = f"""WITH {TOK_LANG}, {_LEX}, per AS (SELECT *, (1960 + doc_id % 60) // 10 * 10 || '-е' AS decade FROM tok),
w AS (SELECT author, decade, doc_id, count(*) AS words FROM per GROUP BY ALL),
hit AS (SELECT lexicon, doc_id, count(*) AS hits FROM per JOIN lex USING (lemma) GROUP BY ALL),
h AS (SELECT author, decade, doc_id, lexicon, coalesce(hits, 0) AS hits, words FROM w CROSS JOIN (SELECT DISTINCT lexicon FROM lex) LEFT JOIN hit USING (lexicon, doc_id))"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok(spark, sf_dir, "lang").withColumn("decade", T.decade(1960 + F.col("doc_id") % 60))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lexicon_hits(_periods(spark, sf_dir), lexicon_table(spark), "author", "decade")


@query(_DEC + " SELECT author, decade, lexicon, count(*) AS texts, sum(words)::BIGINT AS words, round(sum(hits) * 1000 / sum(words), 6) AS per_1000, round(avg((hits > 0)::INT), 6) AS share FROM h GROUP BY ALL")
def lexicon_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(lexicon.lexicon_rates(_hits(spark, sf_dir), "author", "decade"), "per_1000", "share")


@query(_DEC + f""", r AS (SELECT *, row_number() OVER (PARTITION BY author, decade, lexicon ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY author, decade, lexicon) AS m FROM h),
d AS (SELECT author, decade, lexicon, rep, {_DRAW.format('rep', 'i')} % m AS i FROM r, (SELECT unnest(range(1, {BOOT + 1})) AS rep)),
s AS (SELECT author, decade, lexicon, rep, sum(hits) * 1000 / sum(words) AS rate FROM d JOIN r USING (author, decade, lexicon, i) GROUP BY ALL)
SELECT author, decade, lexicon, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM s GROUP BY ALL""")
def lexicon_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sampling.bootstrap_interval(_hits(spark, sf_dir), ["author", "decade", "lexicon"], BOOT), "low", "high")


@query(_DEC + """, c AS (SELECT author, decade, lemma, sum(n)::DOUBLE AS f, count(*) AS df FROM (SELECT author, decade, lemma, doc_id, count(*) AS n FROM per GROUP BY ALL) GROUP BY ALL),
p AS (SELECT *, sum(f) OVER (PARTITION BY author, lemma) AS prior, sum(f) OVER (PARTITION BY author, decade) AS n, sum(f) OVER (PARTITION BY author) AS total FROM c),
q AS (SELECT *, f + n * prior / total AS yt, prior - f + n * prior / total AS yr FROM p),
z AS (SELECT author, decade, lemma, (ln(yt / (n + n - yt)) - ln(yr / (total - n + n - yr))) / sqrt(1 / yt + 1 / yr) AS z, f::BIGINT AS f, df FROM q WHERE df >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY author, decade ORDER BY round(z, 9) DESC, lemma)::INT AS rank FROM z)
SELECT author, decade, lemma, round(z, 6) AS z, f, df, rank FROM k WHERE rank <= 40""")
def decade_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(lexicon.period_keyness(_periods(spark, sf_dir), "decade"), "z")


# Text functions, one row a document

_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_FIRST = "string_split(text, chr(10))[1]"
_TITLE = "array_to_string(regexp_extract_all(translate(replace(lower({0}), 'ё', 'е'), 'aceopxykmthb', 'асеорхукмтнв'), '[а-яa-z0-9]+'), ' ')"


def first_line():
    return F.element_at(F.split("text", "\n", -1), 1)


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^a-zа-я]+', ' ', 'g'), ' ') AS letters FROM documents")
def letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.letters_only(F.col("text")).alias("letters"))


@query(f"SELECT doc_id, {_TITLE.format(_FIRST)} AS key FROM documents")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.title_key(first_line()).alias("key"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(lower({_STRIP.format(_FIRST)}), '[.!?…]+$', ''), '\\s+', ' ', 'g')) AS title FROM documents")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize_title(first_line()).alias("title"))


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN '[Инструментал]' || chr(10) || {0} WHEN doc_id % 3 = 1 THEN {0} ELSE text END"


@query(f"""WITH d AS (SELECT doc_id, lower({_MARKED.format(_FIRST)}) AS low FROM documents), n AS (SELECT *, len(regexp_extract_all(low, '[а-яёa-z]+')) AS words FROM d)
SELECT doc_id, words < 5 OR words < 8 AND (contains(low, 'инструментал') OR contains(low, 'текст временно отсутствует')) AS instrumental FROM n""")
def is_instrumental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts whole, a third by their first line, a third marked as instrumental."""
    third = F.col("doc_id") % 3
    text = F.when(third == 0, F.concat(F.lit("[Инструментал]\n"), first_line())).when(third == 1, first_line()).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", T.is_instrumental(text).alias("instrumental"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]', '', 'g')) AS is_foreign FROM documents")
def is_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.is_foreign(F.col("text")).alias("is_foreign"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_STRIP.format('regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(13), chr(32)), chr(10)), lambda x: ' + _STRIP.format('x') + '), chr(10)), chr(10) || chr(123) || chr(51) || chr(44) || chr(125), chr(10) || chr(10), chr(103))')} AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"WITH {TOK} SELECT CASE WHEN n < 80 THEN '<80' WHEN n <= 160 THEN '80-160' ELSE '>160' END AS bucket, count(*) AS texts FROM (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) GROUP BY bucket")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = docs(spark, sf_dir).select(F.size(T.tokens(F.col("text"))).alias("n")).where("n > 0")
    return sizes.groupBy(T.length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("texts"))


@query("SELECT conv_id, turn, regexp_replace(role || ': ' || string_split(text, chr(10))[1], '^(assistant|user)\\s*:\\s*', '') AS line FROM conversations")
def speaker_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("role", F.lit(": "), first_line())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(said, r"^(assistant|user)\s*:\s*", "").alias("line"))


@query("SELECT event_id, ts, event_type, try_cast(regexp_extract(CAST(ts AS VARCHAR), '^(\\d{4})', 1) AS INT) AS year, ((year(ts)::INT // 10 * 10) || '-е') AS decade FROM events")
def date_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", T.date_year(F.col("ts").cast("string")).alias("year"), T.decade(F.year("ts")).alias("decade"))


# Merge of versions

_VERSIONS = f"""v AS (SELECT {_TITLE.format(_FIRST)} AS key, source AS album, text, doc_id,
  (['studio', 'solo', 'single', 'live', 'compilation', 'other'])[doc_id % 6 + 1] AS kind, doc_id % 6 AS kr, 1960 + doc_id % 60 AS year, doc_id % 17 <> 3 AS accepted FROM documents)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in corpus.KIND_RANK))
    kind = F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int"))
    rank = F.struct(corpus.kind_rank(kind), (1960 + F.col("doc_id") % 60).alias("year"))
    return docs(spark, sf_dir).select(
        T.title_key(first_line()).alias("key"), first_line().alias("title"), F.col("source").alias("album"), rank.alias("rank"), F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 17 != 3).alias("accepted"), "doc_id"
    )


@query(f"WITH {_VERSIONS} SELECT key, arg_min(album, (kr, year, doc_id)) AS album, arg_min(doc_id, (kr, year, doc_id)) AS doc_id, list_sort(list(DISTINCT album)) AS albums FROM v GROUP BY key HAVING bool_and(accepted)")
def title_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_versions(_versions(spark, sf_dir), ["key"], ["doc_id"])


@query(f"WITH {_VERSIONS} SELECT key, count(*) AS versions, bool_and(accepted) AS kept FROM v GROUP BY key")
def version_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).groupBy("key").agg(F.count("*").alias("versions"), F.bool_and("accepted").alias("kept"))


@query(f"WITH v AS (SELECT trim(regexp_replace(regexp_replace(lower({_STRIP.format(_FIRST)}), '[.!?…]+$', ''), '\\s+', ' ', 'g')) AS title_norm, source AS album, doc_id, (doc_id % 6, 1960 + doc_id % 60, doc_id) AS r FROM documents) SELECT title_norm, arg_min(album, r) AS album, arg_min(doc_id, r) AS doc_id, list_sort(list(DISTINCT album)) AS albums FROM v GROUP BY title_norm")
def dedupe_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedupe_versions(_versions(spark, sf_dir), "title", ["doc_id"])


@query("WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN event_type END AS mark FROM events) SELECT event_id, user_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM e")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "events").withColumn("mark", F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 7 == 0), F.col("event_type")))
    return corpus.fill_down(marked, ["user_id"], ["ts", "event_id"], "mark", "filled").select("event_id", "user_id", "filled")


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS album, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS title FROM customer WHERE c_nationkey % 3 = 0),
t AS (SELECT album, title, 'c' || title AS credit, 'l' || album AS lyricist FROM c), s AS (SELECT c_custkey, c_mktsegment AS album, c_nationkey::VARCHAR AS title FROM customer)
SELECT s.c_custkey, s.album, s.title, CASE WHEN e.album IS NOT NULL THEN e.credit WHEN w.album IS NOT NULL THEN w.credit ELSE '-' END AS credit, CASE WHEN e.album IS NOT NULL THEN e.lyricist WHEN w.album IS NOT NULL THEN w.lyricist ELSE '-' END AS lyricist
FROM s LEFT JOIN t e ON s.album = e.album AND s.title = e.title AND e.title <> '' LEFT JOIN t w ON s.album = w.album AND w.title = ''""")
def two_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    album, nation = F.col("c_mktsegment").alias("album"), F.col("c_nationkey")
    credits = customer.where(nation % 3 == 0).select(album, F.when(nation % 5 == 0, "").otherwise(nation.cast("string")).alias("title")).distinct()
    credits = credits.select("album", "title", F.concat(F.lit("c"), "title").alias("credit"), F.concat(F.lit("l"), "album").alias("lyricist"))
    rows = customer.select("c_custkey", album, nation.cast("string").alias("title"), F.lit("-").alias("credit"), F.lit("-").alias("lyricist"))
    return corpus.two_level_lookup(rows, credits, "album", "title", ["credit", "lyricist"])


@query("""WITH e AS (SELECT DISTINCT left(p_name, 6) AS entry FROM part), t AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)
SELECT entry, arg_min(p_name, (p_partkey, p_name)) AS p_name FROM e JOIN t ON starts_with(p_name, entry) GROUP BY entry""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entries = part.select(F.substring("p_name", 1, 6).alias("entry")).distinct()
    titles = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return corpus.prefix_join(entries, titles, "entry", "p_name", "p_partkey")


@query("""WITH t AS (SELECT c_mktsegment AS key, c_name AS album, (['studio', 'live', 'other'])[c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 4 > 0 THEN 1960 + c_custkey % 50 END AS year FROM customer)
SELECT o_orderpriority AS title, c_mktsegment AS key, arg_min(album, (CASE kind WHEN 'studio' THEN 0 WHEN 'live' THEN 3 ELSE 5 END, coalesce(year, 9999), album)) AS album
FROM (SELECT DISTINCT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) JOIN t ON key = c_mktsegment GROUP BY ALL""")
def choose_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    kinds = F.array(F.lit("studio"), F.lit("live"), F.lit("other"))
    k = F.col("c_custkey")
    tracks = customer.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("album"), F.element_at(kinds, (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 4 > 0, (1960 + k % 50)).cast("int").alias("year"))
    named = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == k).select(F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("key")).distinct()
    return corpus.choose_album(named, tracks)


# Features and Delta: authors are languages, folds by source

_FOLD = "(('0x' || substr(md5(source), 1, 8))::BIGINT % 5)::INT"
_FEAT = f"""WITH {TOK_LANG}, f AS (SELECT doc_id, lang, {_FOLD} AS fold FROM documents),
voc AS (SELECT lemma FROM (SELECT lemma, count(*) AS c FROM tok JOIN f USING (doc_id) WHERE fold <> 0 GROUP BY lemma ORDER BY c DESC, lemma LIMIT 150)),
size AS (SELECT doc_id, count(*) AS size FROM tok GROUP BY doc_id), c AS (SELECT doc_id, lemma, count(*) AS c FROM tok GROUP BY ALL),
rel AS (SELECT doc_id, lemma, coalesce(c, 0) / size AS rel FROM size CROSS JOIN voc LEFT JOIN c USING (doc_id, lemma)),
fit AS (SELECT lemma, avg(rel) AS mean, stddev_pop(rel) AS sd FROM rel JOIN f USING (doc_id) WHERE fold <> 0 GROUP BY lemma),
z AS (SELECT doc_id, lemma, (rel - mean) / CASE WHEN sd > 1e-15 THEN sd ELSE 1 END AS z FROM rel JOIN fit USING (lemma)),
cent AS (SELECT lang AS label, lemma, avg(z) AS c FROM z JOIN f USING (doc_id) WHERE fold <> 0 GROUP BY ALL),
dist AS (SELECT doc_id, label, avg(abs(z - c)) AS distance FROM z JOIN cent USING (lemma) JOIN f USING (doc_id) WHERE fold = 0 GROUP BY ALL),
pred AS (SELECT doc_id, arg_min(label, (round(distance, 12), label)) AS predicted FROM dist GROUP BY doc_id),
p AS (SELECT doc_id, lang AS truth, predicted, size AS n_tokens FROM pred JOIN f USING (doc_id) JOIN size USING (doc_id))"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", features.fold_of(F.col("source")).alias("fold"))


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rel, distances, predictions of the documents of fold 0 by all others."""
    fold, words = _folded(spark, sf_dir), tok(spark, sf_dir, "lang")
    train = fold.where("fold <> 0").select("doc_id", F.col("lang").alias("label"))
    counted = words.join(train, "doc_id", "left_semi").groupBy("lemma").agg(F.count("*").alias("f"))
    rel = features.relative_frequencies(words, lexicon.most_frequent(counted, 150))
    fitted = rel.join(train, "doc_id", "left_semi")
    z = features.standardize(fitted, rel)
    test = z.join(fold.where("fold = 0").select("doc_id"), "doc_id", "left_semi")
    distances = features.delta_distances(test, features.centroids(z, train))
    sizes = words.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    found = features.delta_predict(distances).join(fold.select("doc_id", F.col("lang").alias("truth")), "doc_id").join(sizes, "doc_id")
    return rel, distances, found


@query(f"SELECT doc_id, source, {_FOLD} AS fold FROM documents")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source", features.fold_of(F.col("source")).alias("fold"))


@query(_FEAT + " SELECT doc_id, lemma, round(rel, 6) AS rel FROM rel")
def relative_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_delta(spark, sf_dir)[0], "rel")


@query(_FEAT + " SELECT doc_id, label, round(distance, 6) AS distance FROM dist")
def delta_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_delta(spark, sf_dir)[1], "distance")


@query(_FEAT + " SELECT doc_id, truth, predicted, n_tokens FROM p")
def delta_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)[2].select("doc_id", "truth", "predicted", "n_tokens")


#: Predictions for the reports: the language against a hashed guess of it.
_PRED = """p AS (SELECT doc_id, lang AS truth, CASE WHEN ('0x' || substr(md5('g:' || doc_id), 1, 8))::BIGINT % 10 < 7 THEN lang ELSE (['en', 'de', 'es', 'fr'])[(('0x' || substr(md5('g:' || doc_id), 1, 8))::BIGINT % 4) + 1] END AS predicted, n_chars // 6 AS n_tokens FROM documents),
labels_ AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p),
cells AS (SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n FROM labels_ a CROSS JOIN labels_ b LEFT JOIN (SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL) c ON c.truth = a.label AND c.predicted = b.label)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat(F.lit("g:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    other = F.element_at(F.array(*(F.lit(x) for x in ("en", "de", "es", "fr"))), (h % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("truth"), F.when(h % 10 < 7, F.col("lang")).otherwise(other).alias("predicted"), F.floor(F.col("n_chars") / 6).alias("n_tokens"))


@query(f"WITH {_PRED} SELECT truth, predicted, n, round(n * 100 / sum(n) OVER (PARTITION BY truth), 6) AS percent FROM cells")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.confusion_shares(evaluation.confusion(_predictions(spark, sf_dir))), "percent")


@query(f"WITH {_PRED} SELECT least(truth, predicted) AS a, greatest(truth, predicted) AS b, sum(n)::BIGINT AS n FROM cells WHERE truth <> predicted GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10")
def confused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confused_pairs(evaluation.confusion(_predictions(spark, sf_dir)), 10)


def _CLASSES(keys: str) -> str:  # noqa: N802
    by, on = (f"{keys}, ", f"AND x.{keys} = y.{keys}") if keys else ("", "")
    del on
    return f"""sides AS (SELECT {by}truth AS label, 1 AS a, 0 AS p_, (truth = predicted)::INT AS hit FROM q UNION ALL SELECT {by}predicted, 0, 1, 0 FROM q),
sums AS (SELECT {by}label, sum(a)::BIGINT AS actual, sum(p_)::BIGINT AS pr, sum(hit)::BIGINT AS tp FROM sides GROUP BY ALL),
cls AS (SELECT {by}label, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS precision, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS recall, 2 * tp / (pr + actual) AS f1, actual AS support FROM sums)"""


@query(f"WITH {_PRED}, q AS (SELECT * FROM p), {_CLASSES('')} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls")
def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.per_class(_predictions(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {_PRED}, q AS (SELECT *, CASE WHEN n_tokens < 80 THEN '<80' WHEN n_tokens <= 160 THEN '80-160' ELSE '>160' END AS bucket FROM p), {_CLASSES('bucket')} SELECT bucket, sum(support)::BIGINT AS n, round(avg(f1), 6) AS macro_f1 FROM cls GROUP BY bucket")
def macro_f1_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.macro_f1_by_bucket(_predictions(spark, sf_dir)), "macro_f1")


@query("WITH c AS (SELECT l_returnflag AS label, l_partkey::VARCHAR AS name, round(avg(l_discount - l_tax), 9) AS coef FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coef DESC, name)::INT AS rank FROM c WHERE coef > 0) SELECT label, name, round(coef, 6) AS coef, rank FROM k WHERE rank <= 15")
def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_partkey").cast("string").alias("name")).agg(F.round(F.avg(F.col("l_discount") - F.col("l_tax")), 9).alias("coef"))
    return r6(evaluation.top_coefficients(coef, 15), "coef")


_SCORE = "s AS (SELECT event_type AS author, user_id % 3 <> 0 AS known, value AS score FROM events)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("author"), (F.col("user_id") % 3 != 0).alias("known"), F.col("value").alias("score"))


_BEST = f"""{_SCORE}, b AS (SELECT score AS t, count(*) FILTER (known) AS k, count(*) FILTER (NOT known) AS u FROM s GROUP BY score),
c AS (SELECT t, (sum(k) OVER (ORDER BY t DESC) / sum(k) OVER () + coalesce(sum(u) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(u) OVER ()) / 2 AS ba FROM b),
best AS (SELECT max((round(ba, 12), -t)) AS m FROM c)"""


@query(f"WITH {_BEST} SELECT round(-m[2], 6) AS threshold, round(m[1], 6) AS balanced_accuracy FROM best")
def openset_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.best_threshold(_scores(spark, sf_dir)), "threshold", "balanced_accuracy")


@query(f"WITH {_BEST} SELECT author, CASE WHEN known THEN 'known' ELSE 'unknown' END AS role, count(*) AS n, round(median(score), 6) AS median_score, round(avg((score >= -m[2])::INT), 6) AS share_accepted FROM s, best GROUP BY ALL")
def openset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    return r6(evaluation.openset_summary(scores, evaluation.best_threshold(scores)), "median_score", "share_accepted")


@query(f"""WITH {TOK_LANG}, f AS (SELECT doc_id, {_FOLD} AS fold FROM documents), tf AS (SELECT doc_id, lemma AS term, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM f WHERE fold <> 0),
idf AS (SELECT term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN f USING (doc_id), n WHERE fold <> 0 GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tok(spark, sf_dir, "lang").select("doc_id", F.col("lemma").alias("term"))
    return r6(features.tfidf(words, _folded(spark, sf_dir).where("fold <> 0").select("doc_id")), "weight")


# Streaming counts as a batch, pages

@query("WITH w AS (SELECT date_trunc('day', ts) AS start, unnest(regexp_extract_all(replace(event_type, '_', ' '), '\\p{L}+(?:[''’-]\\p{L}+)*')) AS form FROM events) SELECT start, lower(form) AS lemma, count(*) AS f FROM w GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("said"))
    return dictionary.windowed_counts(events, "ts", "said")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a [^>]*href=\"')) AS links FROM pages")
def html_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    links = F.size(F.regexp_extract_all(page, F.lit('<a [^>]*href="'), F.lit(0))).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(page, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(page, '<html lang="([^"]*)"', 1).alias("lang"), links.alias("links"))


@query("SELECT page_id, sha1(url) AS digest, regexp_extract(url, '^\\w+://([^/?#]*)', 1) || '/' || sha1(url) || '.html' AS place FROM pages")
def cache_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import cache_key

    return table(spark, sf_dir, "pages").select("page_id", F.sha1("url").alias("digest"), cache_key(F.col("url")).alias("place"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "title", "lang", "text")


@query()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", F.explode("links").alias("link")).select("page_id", "link.*")


# Models: no SQL form

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("author"), F.col("source").alias("group"), "text", F.transform(T.tokens(F.col("text")), T.normalize_lemma).alias("lemmas"))


@query()
def nb_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(models.cross_validate(models.naive_bayes(), labelled(spark, sf_dir)), "macro_f1", "accuracy")


@query()
def openset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = models.openset(models.classifier(["chars", "lemmas"], 1.0), labelled(spark, sf_dir))
    return r6(evaluation.openset_summary(scores, evaluation.best_threshold(scores)), "median_score", "share_accepted")
