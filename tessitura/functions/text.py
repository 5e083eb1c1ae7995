"""Text functions as Column expressions: all stay in the JVM. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters of the two scripts, marker patterns, placeholders.
TITLE_LATIN, TITLE_CYRILLIC = "aceopxykmthb", "асеорхукмтнв"
LOOSE_LATIN, LOOSE_CYRILLIC = "aceopxyk", "асеорхук"
MIXED_LATIN, MIXED_CYRILLIC = "aceopxykmtbABCEHKMOPTXY", "асеорхукмтвАВСЕНКМОРТХУ"
INSTRUMENTAL_MARKERS = ("инструментал", "текст временно отсутствует")
MARKER_LINE = r"(?iuU)^\[?(припев|проигрыш|куплет|соло|кода)\]?\s*\d*\s*(\([^)]*\))?\s*[:.]?\s*(\*\s*\d+)?\s*$"
MARKER_PREFIX = r"(?iuU)^припев\s*\d*\s*:\s*"
SPEAKER_PREFIX = r"(?iuU)^(майк|боб|бг|б\.\s?г\.)\s*:\s*"
REPEAT_NOTE = r"(?iuU)\s*(\(\s*\d+\s*раза?\s*\)|-?\s*\d+\s*раза?\b|\(\s*и\s+т\.\s*д\.?\s*\))"
WORD = r"(?iu)^[а-яёa-z]+(['’-][а-яёa-z]+)*$"
TOKEN = r"\p{L}+(?:['’-]\p{L}+)*"
_RUN = r"[A-Za-zА-Яа-яЁё]+|[^A-Za-zА-Яа-яЁё]+"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold_yo(text: Column) -> Column:
    return F.replace(text, F.lit("ё"), F.lit("е"))


def normalize_text(text: Column) -> Column:
    """Lines stripped, runs of three line ends or more made two."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def title_key(title: Column) -> Column:
    """Matches titles across spellings: case, ё, Latin look-alikes and punctuation don't count."""
    folded = F.translate(fold_yo(F.lower(title)), TITLE_LATIN, TITLE_CYRILLIC)
    return F.array_join(F.regexp_extract_all(folded, F.lit("[а-яa-z0-9]+"), F.lit(0)), " ")


def loose_title_key(title: Column) -> Column:
    """The same with fewer look-alikes, any non-word characters being one space."""
    folded = F.translate(fold_yo(F.lower(title)), LOOSE_LATIN, LOOSE_CYRILLIC)
    return strip(F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w]+", " "), r"\s+", " "))


def word_title_key(title: Column) -> Column:
    """The title's words without the conjunction «и»."""
    words = F.regexp_extract_all(fold_yo(F.lower(title)), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: w != "и"), " ")


def normalize_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(title)), r"[.!?…]+$", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def normalize_person(name: Column) -> Column:
    """One space after each full stop."""
    return strip(F.regexp_replace(name, r"(?U)\.\s*", ". "))


def album_key(album: Column) -> Column:
    return F.lower(F.regexp_replace(strip(album), r"\.+$", ""))


def to_year(value: Column) -> Column:
    """The number if there are digits alone, else null."""
    digits = strip(value)
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))


def date_year(date: Column) -> Column:
    """The first four digits of a written date."""
    return F.nullif(F.regexp_extract(date, r"^\s*(\d{4})", 1), F.lit("")).try_cast("int")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("-е"))


def is_instrumental(text: Column) -> Column:
    low = F.lower(text)
    words = F.size(F.regexp_extract_all(low, F.lit("[а-яёa-z]+"), F.lit(0)))
    marked = F.contains(low, F.lit(INSTRUMENTAL_MARKERS[0])) | F.contains(low, F.lit(INSTRUMENTAL_MARKERS[1]))
    return (words < 5) | ((words < 8) & marked)


def is_foreign(text: Column) -> Column:
    """More than three tenths of the Latin and Cyrillic letters are Latin."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-zА-Яа-яЁё]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (letters > 0) & (latin / F.greatest(letters, F.lit(1)) > 0.3)


def is_sole(name: Column, surname: Column) -> Column:
    """The surname is in a name that no comma, conjunction or dash joins to another."""
    joined = name.rlike(r"[а-яё][-—–]\s*[А-ЯЁ]|\s[-—–]\s") | name.rlike(r"[,/;&]| и ")
    return F.contains(name, surname) & ~joined


def resolve_author(lyricist: Column, credit: Column, surname: Column, default_to_main: Column) -> Column:
    """Whether the words are the main author's: by the lyricist, else the credit, else by default."""
    persons = F.size(F.regexp_extract_all(credit, F.lit(r"[А-ЯЁ]\.\s?[А-ЯЁ][а-яё]+|[А-ЯЁ][а-яё]+ [А-ЯЁ]\."), F.lit(0)))
    return (
        F.when(lyricist != "", is_sole(lyricist, surname)).when(credit != "", F.contains(credit, surname) & (persons <= 1)).otherwise(default_to_main)
    )


def fix_mixed_script(text: Column) -> Column:
    """Words that mix the scripts get Cyrillic letters for their look-alikes."""
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    fixed = F.transform(runs, lambda w: F.when(w.rlike("[A-Za-z]") & w.rlike("[А-Яа-яЁё]"), F.translate(w, MIXED_LATIN, MIXED_CYRILLIC)).otherwise(w))
    return F.array_join(fixed, "")


def clean_line(line: Column) -> Column:
    """A verse line without markers, speakers and repeat notes; a line that is a marker becomes empty."""
    fixed = F.regexp_replace(fix_mixed_script(strip(line)), r"(?<=[а-яё])-[nN]-(?=[а-яё])", "-н-")
    bare = F.regexp_replace(F.regexp_replace(fixed, MARKER_PREFIX, ""), SPEAKER_PREFIX, "")
    return F.when(fixed.rlike(MARKER_LINE), F.lit("")).otherwise(strip(F.regexp_replace(bare, REPEAT_NOTE, "")))


def clean_text(text: Column) -> Column:
    """Its cleaned lines without empty ones."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), clean_line), lambda x: x != ""), "\n")


def is_word(token: Column) -> Column:
    return token.rlike(WORD)


def has_letter(lemma: Column) -> Column:
    return lemma.rlike(r"\p{L}")


def normalize_lemma(lemma: Column) -> Column:
    return fold_yo(F.lower(lemma))


def letters_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold_yo(F.lower(text)), "[^a-zа-я]+", " "))


def length_bucket(n: Column) -> Column:
    return F.when(n < 80, "<80").when(n <= 160, "80-160").otherwise(">160")


def split_unknown_groups(group: Column, key: Column) -> Column:
    """An unknown album is no album: each such text is its own group."""
    return F.when(F.endswith(group, F.lit(":unknown")), F.concat(group, F.lit("#"), key.cast("string"))).otherwise(group)


def tokens(text: Column) -> Column:
    """Letter runs with inner hyphens and apostrophes, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lower_line_initials(text: Column, proper: Iterable[str] = ()) -> Column:
    """Lower-cases the first letter of each line unless its first word is a known proper noun."""
    names = [x.lower() for x in proper] or [""]
    word = lambda x: F.regexp_extract(x, r"(?U)^\W*([А-ЯЁ][а-яё-]*)", 1)
    at = lambda x: F.length(F.regexp_extract(x, r"(?U)^(\W*)", 1))

    def one(x: Column) -> Column:
        lowered = F.concat(F.substring(x, F.lit(1), at(x)), F.lower(F.substring(x, at(x) + 1, F.lit(1))), F.substring(x, at(x) + 2, F.length(x)))
        return F.when((word(x) != "") & ~F.lower(word(x)).isin(names), lowered).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), one), "\n")
