"""Corpus build: attribution, filters, version merge with a veto, precedence of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Album kinds from the best to the worst source of a text.
KIND_RANK = {"studio": 0, "solo": 1, "single": 2, "live": 3, "compilation": 4, "other": 5}


def kind_rank(kind: Column) -> Column:
    """The place of a kind in KIND_RANK; other names stand last."""
    ranks = F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv))
    return F.coalesce(F.element_at(ranks, kind), F.lit(5))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by order, as a dictionary that is filled row by row keeps it."""
    value = F.max_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(key).agg(value.alias("r")).select("r.*")


def merge_versions(versions: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Groups of versions become one row: the best by (rank, ordinal), with all albums sorted.

    versions has the key, album, rank (a sortable column), ordinal, accepted and the payload. A group with a version
    that is not accepted gives no row. One aggregate, partial before the exchange.
    """
    best = F.min_by(F.struct("album", *payload), F.struct("rank", "ordinal"))
    merged = versions.groupBy(*key).agg(F.bool_and("accepted").alias("ok"), best.alias("b"), F.array_sort(F.collect_set("album")).alias("albums"))
    return merged.where("ok").select(*key, "b.*", "albums")


def dedupe_versions(versions: DataFrame, title: str, payload: list[str]) -> DataFrame:
    """The same by normalized title, without a veto."""
    keyed = versions.withColumn("title_norm", T.normalize_title(F.col(title)))
    best = F.min_by(F.struct("album", *payload), F.struct("rank", "ordinal"))
    return keyed.groupBy("title_norm").agg(best.alias("b"), F.array_sort(F.collect_set("album")).alias("albums")).select("title_norm", "b.*", "albums")


def build_corpus(
    songs: DataFrame, artists: DataFrame, albums: DataFrame, aliases: DataFrame, foreign: DataFrame, dates: DataFrame, kinds: DataFrame, first_releases: DataFrame
) -> DataFrame:
    """The corpus of all artists at once.

    songs: artist, ordinal, title, album, credit, lyricist, text, url. artists: artist, author, surname,
    default_to_main, excluded_kinds (array), albums_must_be_known, default_genre. The rest by artist: albums (album,
    year, kind, line), aliases (alias, album, line), foreign (title), dates (title, year, line), kinds (title, kind,
    line), first_releases (title, album, year, line); of rows with one key the last line holds.

    Rows of excluded kinds, instrumental and foreign ones are left out before the merge and veto nothing.
    """
    known = last_by_key(albums.withColumn("k", T.album_key("album")).withColumn("ak", F.concat_ws("\x01", "artist", "k")), "ak", "line")
    known = known.select("artist", "k", F.col("kind").alias("known_kind"), T.to_year(F.col("year")).alias("known_year"))
    also = last_by_key(aliases.withColumn("k", T.album_key("alias")).withColumn("ak", F.concat_ws("\x01", "artist", "k")), "ak", "line").select("artist", "k", F.col("album").alias("real_album"))

    def titled(df: DataFrame, *columns: Column) -> DataFrame:
        keyed = df.withColumn("key", T.title_key(F.col("title"))).withColumn("tk", F.concat_ws("\x01", "artist", "key"))
        return last_by_key(keyed, "tk", "line").select("artist", "key", *columns)

    out = foreign.select("artist", T.title_key(F.col("title")).alias("key")).distinct().withColumn("is_foreign_title", F.lit(True))
    # The dimensions are small files; the optimizer broadcasts what is below its threshold and shuffles the rest.
    rows = songs.join(artists, "artist").withColumn("k", T.album_key("album")).join(also, ["artist", "k"], "left")
    rows = rows.withColumn("album", F.coalesce("real_album", "album")).withColumn("k", T.album_key("album")).join(known, ["artist", "k"], "left")
    rows = rows.where(~F.col("albums_must_be_known") | F.col("known_kind").isNotNull())
    kind = F.coalesce("known_kind", F.when(F.col("albums_must_be_known"), "other").otherwise("studio"))
    rows = rows.where(~F.array_contains("excluded_kinds", kind) & ~T.is_instrumental(F.col("text")) & ~T.is_foreign(F.col("text")))
    rows = rows.withColumn("key", T.title_key(F.col("title"))).join(out, ["artist", "key"], "left")
    accepted = F.col("is_foreign_title").isNull() & T.resolve_author(F.col("lyricist"), F.col("credit"), F.col("surname"), F.col("default_to_main"))
    ranked = rows.select("*", accepted.alias("accepted"), F.struct(kind_rank(kind), F.coalesce(F.nullif("known_year", F.lit(0)), F.lit(9999))).alias("rank"))
    merged = merge_versions(ranked, ["artist", "key"], ["author", "title", "text", "url", "known_year", "default_genre"])
    dated = titled(dates, T.to_year(F.col("year")).alias("date_year"), F.lit(True).alias("has_date"))
    typed = titled(kinds, F.col("kind").alias("genre"))
    first = titled(first_releases, F.col("album").alias("first_album"), T.to_year(F.col("year")).alias("first_year"), F.lit(True).alias("has_first"))
    full = merged.join(dated, ["artist", "key"], "left").join(typed, ["artist", "key"], "left").join(first, ["artist", "key"], "left")
    year = F.when(F.col("has_first"), F.col("first_year")).when(F.col("has_date"), F.col("date_year")).otherwise(F.col("known_year"))
    full = full.withColumn("year", year).withColumn("album", F.when(F.col("has_first"), F.col("first_album")).otherwise(F.col("album")))
    group = F.when(F.col("album") != "", F.col("album")).when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise("unknown")
    return full.select(
        "author", "artist", "title", "album", "albums", "year", F.coalesce("genre", "default_genre").alias("genre"), F.concat_ws(":", "artist", group).alias("group"), "text", "url"
    )


def fill_down(rows: DataFrame, partition: list[str], order: list[str], column: str, alias: str) -> DataFrame:
    """The last value that is not null up to each row, within a partition."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(alias, F.last(column, ignorenulls=True).over(before))


def two_level_lookup(rows: DataFrame, table: DataFrame, outer: str, inner: str, values: list[str]) -> DataFrame:
    """Values by (outer, inner), else those of (outer, ""), else the row's own; taken as a whole, never mixed."""
    exact = table.where(F.col(inner) != "").select(outer, inner, F.struct(*values).alias("exact"))
    whole = table.where(F.col(inner) == "").select(outer, F.struct(*values).alias("whole"))
    got = rows.join(exact, [outer, inner], "left").join(whole, outer, "left").withColumn("found", F.coalesce("exact", "whole", F.struct(*values)))
    return got.select(*(F.col(f"found.{c}").alias(c) if c in values else F.col(c) for c in rows.columns))


def prefix_join(entries: DataFrame, titles: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """Each entry with the first title that starts with its key.

    The key's first word must be the title's first word or its start, so both sides meet on the first PREFIX characters;
    a shorter key is matched with every prefix of that length in the titles, not with every title.
    """
    width = 4
    left = entries.withColumn("n", F.least(F.length(key), F.lit(width))).withColumn("p", F.substring(F.col(key), F.lit(1), F.col("n")))
    cut = titles.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.length(title), F.lit(width))))).withColumn("p", F.substring(F.col(title), F.lit(1), F.col("n")))
    met = left.join(cut, ["n", "p"]).where(F.startswith(F.col(title), F.col(key)))
    return met.groupBy(*entries.columns).agg(F.min_by(title, F.struct(order, title)).alias(title))


def choose_album(songs: DataFrame, tracklist: DataFrame) -> DataFrame:
    """song, album: of the albums that have its title key, studio first, then the earliest year, unknown years last."""
    rank = F.struct(kind_rank(F.col("kind")), F.coalesce("year", F.lit(9999)), "album")
    return songs.join(tracklist, "key").groupBy("key", "title").agg(F.min_by("album", rank).alias("album"))


def dated(rows: DataFrame, authors: list[str]) -> DataFrame:
    """The rows of these authors that have a year; 0 is no year."""
    return rows.where(F.col("author").isin(*authors) & (F.coalesce("year", F.lit(0)) != 0))
