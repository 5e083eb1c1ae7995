"""Tokens with tags and lemmas: from a lexicon by a join, or from any analyzer that is loaded once in a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values of the lemma conventions.
POSSESSIVES = {"его": "он", "ее": "она", "их": "они"}
LEMMA_FIXES = {"далья": "даль"}
DICTIONARY_FIRST = ("ADVB", "PRED", "COMP")
PARTICIPLES = ("PRTF", "PRTS")
_ARRAYS = "forms array<string>, tags array<string>, lemmas array<string>"

Analysis = tuple[list[str], list[str], list[str]]


def _among(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def combine_lemma(form: Column, lemma: Column, tag: Column, parses: Column) -> Column:
    """A contextual lemma, corrected by dictionary parses (array of struct pos, normal, participle), most likely first.

    In turn: possessives become pronouns; a verb with a participle parse is that participle; adverbs, predicatives and
    comparatives take the dictionary's form; so does a lemma that only repeats a form which no parse has as its normal one.
    """
    own = T.normalize_lemma(lemma)
    head = T.normalize_lemma(F.get(parses, 0)["normal"])
    participle = F.get(F.filter(parses, lambda p: p["pos"].isin(*PARTICIPLES) & p["participle"].isNotNull()), 0)["participle"]
    known = F.exists(parses, lambda p: T.normalize_lemma(p["normal"]) == form)
    chosen = (
        F.when(tag.isin("DET", "PRON") & own.isin(*POSSESSIVES), _among(POSSESSIVES, own))
        .when((tag == "VERB") & participle.isNotNull(), T.normalize_lemma(participle))
        .when(F.get(parses, 0)["pos"].isin(*DICTIONARY_FIRST), head)
        .when((own == form) & (F.size(parses) > 0) & ~known, head)
        .otherwise(own)
    )
    return F.coalesce(_among(LEMMA_FIXES, chosen), chosen)


def with_lexicon(tokens: DataFrame, lexicon: DataFrame, unknown: str = "X") -> DataFrame:
    """tokens (with form) with tag and lemma of a lexicon (form, tag, lemma); other words keep their own form as lemma."""
    known = lexicon.select(T.normalize_lemma(F.col("form")).alias("__form"), F.col("tag").alias("__tag"), F.col("lemma").alias("__lemma"))
    own = T.normalize_lemma(F.col("form"))
    joined = tokens.drop("tag", "lemma").withColumn("__own", own).join(known, F.col("__own") == F.col("__form"), "left")
    return joined.withColumn("tag", F.coalesce("__tag", F.lit(unknown))).withColumn("lemma", F.coalesce("__lemma", "__own")).drop("__own", "__form", "__tag", "__lemma")


def with_analyzer(docs: DataFrame, load: Callable[[], Callable[[str], Analysis]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, forms, tags, lemmas of every text; load() runs once a worker task. Arrays of unequal length are an error."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyze = load()
        for b in batches:
            found = [analyze(t.as_py() or "") for t in b.column(1)]
            if any(len({len(x) for x in f}) > 1 for f in found):
                raise ValueError("an analysis has arrays of unequal length")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.list_(pa.string())) for i in range(3))], [key, "forms", "tags", "lemmas"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {_ARRAYS}")
