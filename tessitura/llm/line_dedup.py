"""Line dedup: lines within one word of an earlier line go, found by a deletion-neighbourhood join.

A line's words are those between ASCII white space, lower-cased. Lines of MIN_WORDS words or more are duplicates when
their words are equal; lines of NEAR_WORDS or more also when one inserted, deleted or replaced word turns one into the
other. A line goes if a duplicate's first occurrence is earlier, by (doc_id, line number); that is judged on the input.

1. Distinct lines with their first occurrence.
2. One edit leaves one half of a line unchanged: lines that share no half with another line are out.
3. The rest emit their words and every variant with one word deleted, as hashed keys. Equal keys meet in an aggregate,
   which keeps the earliest line on either side of an edit; place and length of the deletion verify that the distance is
   one. No pair is ever listed, so a variant that a third of all lines share is one partial aggregate.
4. Each line joins what its variants found; occurrences after the earliest are removed from their texts.

Only texts that have a candidate line, or a line to remove, are shuffled: a bitmap of fixed size tells which may have one.

Defined results: a null text stays null and has no lines; rows with a null doc_id are left out; rows with equal doc_id
and text are one document and give the same result each; of equal lines in the same place none goes; an empty table
gives no rows. Other columns are kept; names that start with __td_ are for this operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, marked_in, stored

MIN_WORDS, NEAR_WORDS = 3, 8


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _split(text: Column) -> Column:
    """The text's lines, lower-cased, with no white space but spaces."""
    low = F.lower(text)
    odd = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\x0c"))
    return F.split(F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low), "\n", -1)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def _halves() -> list[Column]:
    """Hashes of a line's two halves, cut for a partner of the same or more words, and for one of a word less."""
    out = []
    for less in (0, 1):
        n, cut = F.col("n") - less, ((F.col("n") - less) / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), n, F.slice("words", F.lit(1), cut)))
        out.append(F.xxhash64(F.lit(1), n, F.slice("words", F.col("n") - (n - cut) + 1, n - cut)))
    return [F.when(F.col("n") >= NEAR_WORDS, c).alias(f"k{i}") for i, c in enumerate(out)]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), line, n, h and g (two hashes of the words), k0 to k3 of every line: the texts' only full split."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", _key().alias("th"), F.posexplode(_split(F.col("text"))).alias("line", "s"))
    words = split.select("doc_id", "th", "line", _words(F.col("s")).alias("words")).withColumn("n", F.size("words"))
    return words.select("doc_id", "th", "line", "n", F.xxhash64("words").alias("h"), F.hash("words").alias("g"), *_halves())


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, removed (line numbers from 0) of the documents that lose a line."""
    lines = stored(_lines(docs), "occurrences").where(F.col("n") >= MIN_WORDS)
    firsts = stored(
        lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line", "th")).alias("first"), F.count("*").alias("times"), F.max("n").alias("n"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4))),
        "lines",
    )
    halves = firsts.where(F.col("n") >= NEAR_WORDS).select("h", "g", F.explode(F.array(*(f"k{i}" for i in range(4)))).alias("k"))
    shared = halves.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    candidates = halves.join(shared, "k").select("h", "g").distinct()
    places = stored(firsts.join(candidates, ["h", "g"]).select("h", "g", "first"), "candidates")
    near = _nearest(docs, places)
    decided = firsts.join(near, ["h", "g"], "left").select(
        "h", "g", F.least(F.struct("first.doc_id", "first.line"), F.coalesce("near", F.struct("first.doc_id", "first.line"))).alias("keep"), "times", "near"
    )
    decided = decided.where((F.col("times") > 1) | F.col("near").isNotNull()).select("h", "g", "keep")
    gone = lines.select("doc_id", "th", "line", "h", "g").join(decided, ["h", "g"]).where(F.struct("doc_id", "line") > F.col("keep"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("removed"))


def _variants(words: Column, n: Column) -> Column:
    """(v, at) of the words themselves (at -1) and without the word at each place.

    A sequence's hash is the exclusive or of one hash for each (word, place). Without word 0 all others move up a place;
    from one variant to the next, one word comes in and the next goes out: so a line's variants cost one pass.
    """
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    up = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))
    none = F.lit(0).cast("bigint")
    total = F.aggregate(here, none, lambda x, y: x.bitwiseXOR(y))
    without_first = F.aggregate(up, none, lambda x, y: x.bitwiseXOR(y)).bitwiseXOR(F.get(up, F.lit(0)))
    steps = F.zip_with(F.slice(here, F.lit(1), n - 1), F.slice(up, F.lit(2), n - 1), lambda x, y: x.bitwiseXOR(y))
    each = F.aggregate(steps, F.array(without_first), lambda found, x: F.array_append(found, F.element_at(found, -1).bitwiseXOR(x)))
    deleted = F.transform(each, lambda x, i: F.struct(F.xxhash64(n - 1, x).alias("v"), i.alias("at")))
    return F.concat(F.array(F.struct(F.xxhash64(n, total).alias("v"), F.lit(-1).alias("at"))), deleted)


def _nearest(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h, g, near: the earliest first occurrence of a line within one word, if it is earlier than the line's own."""
    wanted = places.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_set(F.struct("first.line", "h", "g")).alias("at"))
    bits = bitmap(places, F.col("first.th"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", _key().alias("th"), "text").where(marked_in(bits, F.col("th")))
    own = texts.join(wanted, ["doc_id", "th"]).select("doc_id", _split(F.col("text")).alias("lines"), F.explode("at").alias("at"))
    own = own.select("at.h", "at.g", F.struct("doc_id", "at.line").alias("first"), _words(F.get("lines", F.col("at.line"))).alias("words"))
    own = own.select("h", "g", "first", F.explode(_variants(F.col("words"), F.size("words"))).alias("e"))
    keys = stored(own.select("h", "g", "first", "e.v", "e.at"), "variants")
    # Replaced: equal variants of the same place. Inserted or deleted: a whole line equal to a variant of a longer one.
    best = keys.groupBy("v", "at").agg(F.min("first").alias("m"), F.count("*").alias("c"))
    best = stored(best, "best")
    sides = best.groupBy("v").agg(F.min(F.when(F.col("at") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("m"))).alias("part"), F.sum("c").alias("c")).where("c > 1")
    by_place = best.where("at >= 0 and c > 1").select("v", "at", F.col("m").alias("near"))
    found = keys.join(by_place, ["v", "at"]).select("h", "g", "first", "near").union(
        keys.join(sides, "v").select("h", "g", "first", F.when(F.col("at") < 0, F.col("part")).otherwise(F.col("whole")).alias("near"))
    )
    return found.where(F.col("near") < F.col("first")).groupBy("h", "g").agg(F.min("near").alias("near"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without removed lines, and __td_lines and __td_removed: how many there were."""
    gone = stored(removed_lines(docs), "removed")
    bits = bitmap(gone, F.col("th"))
    own = docs.where("doc_id is not null").withColumn("__td_th", _key())
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    marked = F.col("text").isNotNull() & marked_in(bits, F.col("__td_th"))
    right = gone.select(F.col("doc_id").alias("__td_id"), F.col("th").alias("__td_key"), F.col("removed").alias("__td_gone"))
    changed = own.where(marked).join(right, (F.col("doc_id") == F.col("__td_id")) & (F.col("__td_th") == F.col("__td_key")), "left")
    lost = F.coalesce(F.col("__td_gone"), F.array().cast("array<int>"))
    changed = changed.withColumn("__td_split", F.split("text", "\n", -1)).withColumn("__td_lines", F.size("__td_split")).withColumn("__td_removed", F.size(lost))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.col("__td_lines") - 1), lost), lambda i: F.get("__td_split", i))
    changed = changed.withColumn("text", F.array_join(kept, "\n")).drop("__td_split", "__td_id", "__td_key", "__td_gone", "__td_th")
    same = own.where(~marked).withColumn("__td_lines", count).withColumn("__td_removed", F.lit(0)).drop("__td_th")
    return same.unionByName(changed)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__td_lines").cast("bigint").alias("n_lines"), F.col("__td_removed").cast("bigint").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


#: The same in DuckDB SQL over the view documents.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL
), o AS (
  SELECT r, doc_id, i - 1 AS line, list_filter(regexp_split_to_array(lower(lines[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), l AS (SELECT * FROM o WHERE len(words) >= {MIN_WORDS}
), f AS (SELECT words, min((doc_id, line)) AS first FROM l GROUP BY words
), v AS (
  SELECT words, first, place, CASE WHEN place < 0 THEN words ELSE list_concat(words[1:place], words[place + 2:len(words)]) END AS v
  FROM (SELECT words, first, unnest(range(-1, len(words))) AS place FROM f WHERE len(words) >= {NEAR_WORDS})
), n AS (
  SELECT a.words, min(b.first) AS near FROM v a JOIN v b ON a.v = b.v AND b.first < a.first
    AND (len(a.words) = len(b.words) AND a.place = b.place OR len(a.words) = len(b.words) + 1 AND b.place < 0 OR len(b.words) = len(a.words) + 1 AND a.place < 0)
  GROUP BY a.words
), k AS (SELECT words, least(first, coalesce(near, first)) AS keep FROM f LEFT JOIN n USING (words)
), g AS (SELECT r, list(line) AS gone FROM l JOIN k USING (words) WHERE (doc_id, line) > keep GROUP BY r
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: lines[i + 1]), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
