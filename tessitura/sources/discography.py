"""What ties songs to albums, dates and lyricists: keyed tables, track lists, title indexes, dated comments, scrapes.

Pages are rows (url, html). A page is parsed in Arrow batches; everything after that is joins on title keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import readers
from .html import label, parse, select
from .songs import Song, read

# Sections and their kinds, the names that mark a held-out collaboration, dated comments.
SECTION_KINDS = {
    "Естественные Альбомы Аквариума и БГ": "studio",
    "Англоязычные Альбомы": "studio",
    "Альбомы 70-х лет": "studio",
    "Синглы": "single",
    "Концертные Записи": "live",
    "Антологии": "compilation",
    "Компиляции": "compilation",
    "Чужие Сборники": "compilation",
}
MIXED_SECTION = "Сборники и Синглы"
HELD_OUT_KEYS, HELD_OUT_NAME = ("липкий пульс", "симбол"), "symbol"
COMMENTARY = "Комментарии"
DATED = re.compile(r"стр\.\s*\d+,?\s*(?:\(\*\);\s*)?([^.]*\d{4})")


# Keyed tables


def title_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value: a column of a table by its title's key; of rows with one key the last line holds."""
    rows = readers.tsv(spark, path, ["title", value]).withColumn("key", T.loose_title_key(F.col("title")))
    return rows.groupBy("key").agg(F.max_by(value, "line").alias(value))


def albums(spark: SparkSession, path: str) -> DataFrame:
    """page, album, year (null where the table has none), kind, line."""
    rows = readers.tsv(spark, path, ["page", "album", "year", "kind"])
    return rows.withColumn("year", T.to_year(F.col("year")))


def section_kind(section: Column) -> Column:
    pairs = [F.lit(x) for kv in SECTION_KINDS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), section), F.lit("other"))


def album_kind(section: Column, album: Column) -> Column:
    """studio, but in the section of compilations and singles what its title says."""
    mixed = F.when(F.contains(F.lower(album), F.lit("сингл")), F.lit("single")).otherwise(F.lit("compilation"))
    return F.when(section == MIXED_SECTION, mixed).otherwise(F.lit("studio"))


def with_lyricist(songs: DataFrame, exceptions: DataFrame, default: str) -> DataFrame:
    """songs with lyricist: the exception of the title's key, else the default."""
    named = exceptions.select(F.col("key").alias("__key"), F.col("lyricist").alias("__lyricist"))
    joined = songs.drop("lyricist").join(named, T.loose_title_key(F.col("title")) == F.col("__key"), "left")
    return joined.withColumn("lyricist", F.coalesce("__lyricist", F.lit(default))).drop("__key", "__lyricist")


# Indexes and track lists


def numbered_tracks(page: str) -> list[str]:
    """Titles of "N. Title 3:45" paragraphs before the first h3; italics, where there are any, are the title alone."""
    out = []
    for n in parse(page).find_all("p", "h3"):
        if n.name == "h3":
            break
        numbered = re.match(r"\d{1,2}\s*\.\s*(.+)", label(n))
        if numbered:
            italic = n.find("i")
            out.append(label(italic) if italic is not None else re.sub(r"\s+\d{1,2}:\d{2}$", "", numbered[1]))
    return out


def track_lists(pages: DataFrame) -> DataFrame:
    """url, ordinal, track, key of every album page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(u.as_py(), i, t) for u, h in zip(b.column(0), b.column(1), strict=True) for i, t in enumerate(numbered_tracks(h.as_py() or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["url", "ordinal", "track"])

    return pages.select("url", "html").mapInArrow(run, "url string, ordinal int, track string").withColumn("key", T.loose_title_key(F.col("track")))


def title_index(links: DataFrame, base: str, href: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """key, target: the first link (ordinal, text, href) of each title key, with or without a counter and parentheses."""
    bare = F.regexp_replace("text", r"(?U)\s+\d$", "")
    both = F.array(bare, F.regexp_replace(bare, r"\s*\(.*?\)", ""))
    rows = links.where(F.col("href").rlike(href)).select("ordinal", "href", F.posexplode(both).alias("step", "title")).withColumn("key", T.title_key(F.col("title")))
    for raw, fixed in (aliases or {}).items():
        rows = rows.withColumn("key", F.when(F.col("key") == T.title_key(F.lit(raw)), T.title_key(F.lit(fixed))).otherwise(F.col("key")))
    found = rows.groupBy("key").agg(F.min_by("href", F.struct("ordinal", "step")).alias("href"))
    return found.select("key", F.udf(lambda h: urljoin(base, h), "string")(F.col("href")).alias("target"))


def find_tracks(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (album, title) with target: by the title's key, else by that of the title without its parentheses."""
    keyed = wanted.withColumn("__k", T.title_key(F.col("title"))).withColumn("__b", T.title_key(F.regexp_replace("title", r"\s*\(.*?\)", "")))
    one = index.select(F.col("key").alias("__k"), F.col("target").alias("__one"))
    two = index.select(F.col("key").alias("__b"), F.col("target").alias("__two"))
    return keyed.join(one, "__k", "left").join(two, "__b", "left").withColumn("target", F.coalesce("__one", "__two")).drop("__k", "__b", "__one", "__two")


def is_held_out(title: Column) -> Column:
    """Whether a title names the collaboration that never goes into training, in either script."""
    key = T.title_key(title)
    hit = F.contains(F.lower(title), F.lit(HELD_OUT_NAME))
    for name in HELD_OUT_KEYS:
        hit = hit | F.contains(key, F.lit(name))
    return hit


def block_song(page: str, url: str, block: str) -> list[Song]:
    """The text of the page's first such block."""
    from .songs import flow

    box = next(iter(select(parse(page), block)), None)
    text = flow([box]) if box is not None else ""
    return [Song("", text)] if text else []


def songs_of_tracks(tracks: DataFrame, pages: DataFrame, block: str, source: str) -> DataFrame:
    """source, title, album, text, url of the found tracks whose page has a text; held-out titles are left out first."""
    found = read(pages, lambda page, url: block_song(page, url, block), source).select("text", "url")
    wanted = tracks.where(F.col("target").isNotNull() & ~is_held_out(F.col("title")))
    return wanted.join(found, wanted["target"] == found["url"]).select(F.lit(source).alias("source"), "title", "album", "text", "url")


# Dates in a book's comments


def commentary(chapters: DataFrame, heading: str = COMMENTARY) -> DataFrame:
    """path, html of the first chapter of each book that has this heading; a book without one gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [any(label(n) == heading for n in parse(h.as_py() or "").find_all("h1", "h2", "h3", "title")) for h in b.column(2)]
            yield b.filter(pa.array(hit, pa.bool_()))

    named = chapters.select("path", "ordinal", "html").mapInArrow(run, "path string, ordinal int, html string")
    return named.groupBy("path").agg(F.min_by("html", "ordinal").alias("html"))


def dated_titles(page: str) -> list[tuple[str, str, int | None]]:
    """(title, date as written, last year in it) of each subtitle whose next paragraph begins with a page and a date."""
    out, title = [], None
    for n in parse(page).find_all("p"):
        if "subtitle" in n.classes:
            title = label(n)
        elif title is not None:
            if found := DATED.match(label(n)):
                years = re.findall(r"\d{4}", found[1])
                out.append((title, found[1].strip(), int(years[-1]) if years else None))
            title = None
    return out


def attach_titles(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """entries (entry, ...) with title, null where none fits; titles: title, ordinal.

    In turn: equal keys; the key without a last parenthesis; for an entry that breaks off (… or ...) the first title that
    begins with it. Of titles with one key the last one holds.
    """
    keyed = titles.withColumn("key", T.word_title_key(F.col("title")))
    known = keyed.groupBy("key").agg(F.max_by("title", "ordinal").alias("title"), F.min("ordinal").alias("ordinal"))
    rows = entries.withColumn("__k", T.word_title_key(F.col("entry"))).withColumn("__b", T.word_title_key(F.regexp_replace("entry", r"\s*\([^)]*\)\s*$", "")))
    one, two = (known.select(F.col("key").alias(k), F.col("title").alias(t)) for k, t in (("__k", "__one"), ("__b", "__two")))
    rows = rows.join(one, "__k", "left").join(two, "__b", "left").withColumn("__id", F.monotonically_increasing_id())
    open_ended = rows.where(F.coalesce("__one", "__two").isNull() & F.regexp_replace("entry", "»+$", "").rlike(r"(\.\.\.|…)$"))
    begun = open_ended.select("__id", "__k").join(known, F.startswith(F.col("key"), F.col("__k"))).groupBy("__id").agg(F.min_by("title", "ordinal").alias("__three"))
    joined = rows.join(begun, "__id", "left")
    return joined.withColumn("title", F.coalesce("__one", "__two", "__three")).drop("__k", "__b", "__one", "__two", "__three", "__id")


# Scrapes


def scrape(index: list[str], links: Callable[[str, str], list], fetch: Callable[[list[str]], DataFrame], family: str | Callable, source: str) -> tuple[DataFrame, DataFrame]:
    """Songs of a site, and the addresses of pages without any. index: its index pages; links: (page, address) to entries
    with url, each address once; fetch: addresses to pages (url, html), cached on disk."""
    heads = fetch(index).select("url", "html").collect()  # the few index pages
    order = {h["url"]: h["html"] for h in heads}
    found = list(dict.fromkeys(e.url for u in index for e in links(order.get(u) or "", u)))
    pages = fetch(found)
    songs = read(pages, family, source)
    own = songs.select(F.regexp_replace("url", "#.*$", "").alias("url")).distinct()
    return songs, pages.select("url").join(own, "url", "left_anti")


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in the order given."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__at", at).where("__at = 1").drop("__at")
