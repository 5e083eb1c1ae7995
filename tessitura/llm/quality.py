"""Quality rules: a table of thresholds compiled into one projection, evaluated without user functions.

Defined results: null or empty text: no words, which fails the base rule; rows with a null doc_id are left out; repeated
rows each give a row; an empty table gives none. A ratio without a denominator counts as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, spaced_words

WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # words; repeated words of a hundred
SYMBOLS, BLANKS = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"
#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in is was that for with by on as it this "
    "der die und das den von mit ein eine nicht ist "
    "el los las del que y un una en por se "
    "le la les de des et est dans pour du au pas"
).split()
#: Rule: ratio name, smallest and largest value that passes (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.05),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.40),
    ("stutter_ratio", None, 0.30),
    ("words_a_line", 3.0, None),
)


def _let(value: Column, body) -> Column:
    """body of value, which is computed once: a lambda's argument over an array of one element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of so many words that the same array holds twice or more."""
    n = F.size(words) - F.lit(window - 1)
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(at - acc["last"], F.lit(window))).alias("n"), at.alias("last"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def twice(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = lambda p, i, j: p["h"] == F.get(pairs, j)["h"]
        kept = F.filter(pairs, lambda p, i: ((i > 0) & same(p, i, i - 1)) | ((i < last) & same(p, i, i + 1)))
        return covered(F.sort_array(F.transform(kept, lambda p: p["i"])))

    def over(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(_let(pairs, twice))

    return _let(hashes, over)


def measures(text: Column) -> dict[str, Column]:
    """The measures that need the text; `words` and `lines` are arrays that rate() has laid beside it."""
    words, lines = F.col("words"), F.col("lines")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("bigint"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "n_stutters": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("bigint"),
    }


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word_length": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "stutter_ratio": share("n_stutters", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
    }


def compile_rules(rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> Column:
    """One condition that holds where every rule passes."""
    known = ratios()
    tests = [known[name] >= low for name, low, _ in rules if low is not None] + [known[name] <= high for name, _, high in rules if high is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def rate(docs: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents(docs).select("doc_id", text.alias("text"))
    laid = own.select("doc_id", "text", spaced_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    measured = laid.select("doc_id", *(c.alias(k) for k, c in measures(F.col("text")).items()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")
    )


#: The same in DuckDB SQL over the view documents.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), reach AS (
  SELECT r, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW})) AS fresh FROM twice
), repeated AS (SELECT r, sum(fresh)::BIGINT AS n FROM reach GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM w LEFT JOIN repeated USING (r)
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / word_chars <= 0.05
  AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.4 AND n_stutters / n_words <= 0.3 AND n_words / n_lines >= 3.0 AS kept
FROM b
"""
